import pathlib
import subprocess
import sys

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry_lives_without_a_library_of_the_corpus_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 80 and "xxhash" in said.stderr
