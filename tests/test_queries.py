"""Every query with SQL against DuckDB on the smallest tables; the rest runs."""

import importlib.util
import os

import duckdb
import pytest

from pressmill.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in sorted(columns)) for r in df.collect()))) == sorted(map(repr, want))


def test_entry_and_names(spark):
    spec = importlib.util.find_spec("__spark_entry__")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert len(entry.entry(spark).collect()) == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_latest_run_has_one_scan_of_orders(spark):
    plan = registry.queries()["J4_latest_run"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PushedFilters: []" not in plan.replace(" ", " ") or "o_orderstatus" in plan


def test_import_items_of_all_runs(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    got = registry.queries()["V11_import_items"](spark, FOLDER)
    assert got.count() == events.filter("event_type = 'error'").count() > 100


def test_detail_of_every_document(spark):
    got = registry.queries()["V7_document_detail"](spark, FOLDER)
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet")
    assert got.select("document_key").distinct().count() == customers.count() > 50
    assert {"document_key", "status", "error_summary"} <= set(got.columns) and got.filter("article_id is null").count() > 0


def test_every_row_has_its_place(spark):
    got = registry.queries()["O1_processing_order"](spark, FOLDER)
    places = sorted(r.place for r in got.collect())
    assert places == list(range(1, len(places) + 1)) and len(places) > 100


def test_items_of_every_status_are_counted(spark):
    rows = registry.queries()["A7_items_by_status"](spark, FOLDER).collect()
    assert sum(r.imported + r.skipped + r.failed for r in rows) == spark.read.parquet(f"{FOLDER}/events.parquet").count()


def test_every_type_of_item_has_its_checkpoint(spark):
    kinds = {r[0] for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_type").distinct().collect()}
    assert {r.item_type for r in registry.queries()["A9_checkpoint_max"](spark, FOLDER).collect()} == kinds and "view" in kinds


def test_details_without_tags_read_no_tags(spark):
    """An unused join with tags was made, whose shuffle is larger than all others."""
    for name in ("V9_processing_detail", "V7_document_detail", "P8_enrichment_defaults"):
        assert not [f for f in registry.queries()[name](spark, FOLDER).inputFiles() if f.endswith("/part.parquet")]


@pytest.mark.parametrize("name", ["V9_processing_detail", "V3_article_detail"])
def test_details_do_not_move_by_article(spark, name):
    """Enrichment runs, outputs, images, pages, tags and bodies were each shuffled by the article's id, a text."""
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(" in plan and "hashpartitioning(article_id" not in plan and "hashpartitioning(article_key" not in plan


@pytest.mark.parametrize("name", ["V9_processing_detail", "V3_article_detail"])
def test_details_of_odd_lines(spark, tmp_path, name):
    """Lines that occur twice, several lines of a part and supplier, values that lack, parts that aren't there."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view whole_{t} as select * from '{FOLDER}/{t}.parquet'")
    con.execute(
        "create view odd as with l as (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey) as n from whole_lineitem) "
        "select * replace (case when n % 4 = 0 then 7 else l_partkey end as l_partkey, case when n % 4 = 0 then 3 else l_suppkey end as l_suppkey, case when n % 17 = 1 then null else l_quantity end as l_quantity, case when n % 19 = 1 then null else l_shipdate end as l_shipdate, "
        "case when n % 23 = 1 then null else l_returnflag end as l_returnflag, case when n % 29 = 1 then null else l_extendedprice end as l_extendedprice) from l where n <= 900"
    )
    con.execute(f"copy (select * exclude (n) from odd union all select * exclude (n) from odd where n % 5 = 0) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"copy (select * from whole_part where p_partkey % 6 <> 2) to '{tmp_path}/part.parquet' (format parquet)")
    for t in TABLES:
        if t not in ("lineitem", "part"):
            os.symlink(f"{FOLDER}/{t}.parquet", tmp_path / f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()]
    got = [tuple(r[c] for c in sorted(columns)) for r in df.collect()]
    assert len(got) == len(want) > 100 and sorted(map(repr, got)) == sorted(map(repr, want))
