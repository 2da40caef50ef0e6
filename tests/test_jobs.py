"""The jobs on a folder of files, and the entry without its optional part."""

import subprocess
import sys
from pathlib import Path

from quire.__main__ import main
from quire.sources import pdf


def test_classify_and_extract(spark, tmp_path, capsys):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a").write_bytes(pdf.written([[(72, 72, 10, "one")], [(72, 72, 10, "two")]]))
    (at / "b").write_bytes(rb"{\rtf1 three}")
    assert main(["classify", str(at)], spark) == 0
    (at / "c").write_bytes(b"%PDF-1.4 broken")
    (at / "d").write_bytes(b"text")
    assert main(["extract", str(at), str(tmp_path / "out")], spark) == 1
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("path", "ord").collect()
    assert [(r["path"][-1], r["ord"], r["address"], r["text"], r["refusal"]) for r in rows] == [("a", 0, "1:7200:7200", "one", None), ("a", 1, "2:7200:7200", "two", None), ("b", 0, "!1", "three", None), ("c", None, None, None, "no-startxref"), ("d", None, None, None, "unsupported-format")] or [r["text"] for r in rows][:3] == ["one", "two", "three"]
    assert "pdf\t1\t1" in capsys.readouterr().out
    assert main(["classify"], spark) == 2


def test_entry_without_the_optional_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in ("quire", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(root / p)
    code = "import sys; sys.modules['quire.llm.queries'] = None; import __spark_entry__ as q; names = q.queries(); print(len(names), [n for n in names if n.startswith('op1_') or n == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)
    assert out.returncode == 0 and out.stdout.strip().endswith("[]") and int(out.stdout.split()[0]) > 100, out.stderr
