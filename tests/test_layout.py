"""Nothing outside the subpackage of training-data operators imports it."""

import re
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_llm_stands_alone():
    for p in [*(ROOT / "filegrain").rglob("*.py")]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"filegrain\.llm|from \.+llm|corpus_pipeline", p.read_text()), p


def test_no_local_checkpoint():
    for p in [*(ROOT / "filegrain").rglob("*.py"), *ROOT.glob("*.py")]:
        assert not re.search(r"localCheckpoint\(|\.crossJoin\(", p.read_text()), p
