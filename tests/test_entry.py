import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 35
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 40


def test_entry_imports_without_the_libraries_of_the_corpus_operators():
    hide = "import sys; sys.modules.update({'public_tokenizers': None, 'tiktoken': None}); import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q))"
    out = subprocess.run([sys.executable, "-c", hide], cwd=ROOT, capture_output=True, text=True)
    n, *rest = out.stdout.split()
    assert int(n) > 80 and rest == ["False", "False"], out.stderr[-500:]


def test_queries_of_a_session_share_their_models(spark):
    from fleetledger.plans import registry

    assert registry.shared(spark, "/a") is registry.shared(spark, "/a") and registry.shared(spark, "/a") is not registry.shared(spark, "/b")
