"""What jobs write in the shared folder is gone when the driver has ended."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
import __spark_entry__ as entry
from loomwork.session import local_session

spark = local_session(2, **{"spark.checkpoint.dir": "file://" + sys.argv[1], "spark.sql.shuffle.partitions": "4"})
for name in ("op1_simhash", "op12_alignment", "op11_token_files", "pipeline"):
    assert entry.queries()[name](spark, sys.argv[2]).count() > 0
spark.stop()
"""


def test_the_shared_folder_is_empty_in_the_end(tmp_path, sf):
    root = Path(__file__).resolve().parents[2]
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), sf], cwd=root, check=True, capture_output=True, timeout=600)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
