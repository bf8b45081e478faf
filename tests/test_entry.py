import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


HERE = (ROOT / "sparkloom" / "llm").is_dir()


@pytest.mark.parametrize("name, well", [("sparkloom.llm", True), ("sparkloom.llm.tokenizer", not HERE), ("numpy", False)])
def test_only_the_subpackage_may_be_absent(name, well):
    code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; assert 'p5_found' in e.queries()"
    assert (subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=60).returncode == 0) == well
