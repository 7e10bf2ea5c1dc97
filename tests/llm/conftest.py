import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}"
