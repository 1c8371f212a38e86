"""Print the queries registered by one module of the catalogue."""

import re
import sys
from pathlib import Path

plans = Path(__file__).resolve().parents[1] / "heatloom" / "plans"
print(" ".join(re.findall(r'@query\("(\w+)"', (plans / f"{sys.argv[1]}.py").read_text())))
