import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests" / "llm"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))
