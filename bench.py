"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from heatloom.plans.catalogue import QUERIES  # noqa: E402
from heatloom.session import build_session  # noqa: E402

HEADLINE = [
    "topic_heat", "total_heat", "heat_trend", "cluster_docs", "cluster_tfidf", "word_count", "tokenize_clean",
    "term_frequency", "tfidf", "tfidf_top_terms", "doc_hotwords", "doc_cosine", "vocabulary", "kwic",
    "kwic_cross_document", "cooccurrence_edges", "textrank_per_doc", "textrank_per_cluster", "hotword_rank",
    "textrank_corpus", "segment_corpus", "chat_word_count", "naive_bayes", "news_nb", "center_distance",
    "kmeans_assign", "nearest_vectors", "column_summary", "row_index", "word_cloud",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_counts"](spark, root).collect()  # start the executors and load the classes
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = Path(root).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
