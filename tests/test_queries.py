"""Registered queries against their SQL twins on the smallest tables."""

import pathlib
import subprocess
import sys

import duckdb
import pytest

import check
from tidewatch import catalog

catalog.load()
ROOT = pathlib.Path(__file__).resolve().parent.parent
# One query per family here; check.py compares all of them.
NAMES = [
    "w03_first_crossing", "a16_forward_labels", "w04_mindshare_rank", "p15_verdict", "x10_composite",
    "w01_latest_per_key", "u03_changed_labels", "a01_pool_aggregate", "s18_evm_safety", "j11_merge_safety",
    "m06_auc_by_stratum", "m08_decile_lift", "k01_candle_grid", "w17_volume_heat", "s01_read_journal",
    "o02_current_board", "a13_base_rate_by_band", "j13_fold_social",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = (df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(catalog.ORACLES[name])
    want = ([c[0] for c in res.description], res.fetchall())
    assert check.compare(got, want) is None


def test_queries_are_listed_where_a_module_of_the_training_data_package_is_missing():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, llm = out.stdout.split()
    assert int(n) > 190 and llm == "False", out.stderr
