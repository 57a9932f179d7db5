import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import Contract, sum_by
from ledgerflow.plans import Busy, Context, Output, Pipeline, Publisher, PublishError, csv_file, csv_file_set, custom, run_pipelines
from ledgerflow.plans.runner import SpecError
from ledgerflow.schema import Column


def sales(tmp_path, text="Регион;Сумма\nСевер;1200\nЮг;950\nСевер;1730\nЮг;400\n"):
    path = tmp_path / "sales.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


class ByRegion(Pipeline):
    output = Output("by_region", Contract({"Регион": "region", "total": "total"}), updated_at="db_updated_at")
    roles = {"rows": "sales"}

    def run(self, ctx: Context, rows):
        return sum_by(rows.withColumn("n", F.col("Сумма").cast("bigint")), ["Регион"], {"total": "n"})


class Fixed(Pipeline):
    output = Output("fixed", schema=(Column("n", "INTEGER", False),), strategy="refill", share_as="numbers")
    roles = {}

    def run(self, ctx: Context):
        return ctx.spark.sql("select 1 as n")


class Broken(Pipeline):
    output = Output("broken")
    roles = {}

    def run(self, ctx: Context):
        raise RuntimeError("no")


def test_run_skip_change_and_force(spark, tmp_path):
    pub = Publisher(spark, str(tmp_path / "pub"))
    go = lambda **k: run_pipelines(spark, "t", [ByRegion, Fixed], [csv_file("sales", sales_path)], pub, **k)
    sales_path = sales(tmp_path)
    first = go()
    assert first.status == "published" and first.rows == {"by_region": 2, "fixed": 1}
    assert sorted((r.region, r.total) for r in pub.read("by_region").collect()) == [("Север", 2930), ("Юг", 1350)]
    assert pub.read("by_region").columns == ["region", "total", "db_updated_at"] and pub.provenance("by_region")["task"] == "t"
    assert (go().status, go().reason) == ("skipped", "sources_unchanged")
    assert go(force=True).status == "published"
    sales(tmp_path, "Регион;Сумма\nЮг;1\nВосток;20\n")
    assert go().status == "published" and {r.region for r in pub.read("by_region").collect()} == {"Юг", "Восток"}


def test_failure_leaves_everything_as_it_was(spark, tmp_path):
    pub = Publisher(spark, str(tmp_path / "pub"))
    src = [csv_file("sales", sales(tmp_path))]
    run_pipelines(spark, "t", [ByRegion], src, pub)
    before = pub.manifest()
    sales(tmp_path, "Регион;Сумма\nЮг;1\n")
    with pytest.raises(RuntimeError, match="no"):
        run_pipelines(spark, "t", [ByRegion, Broken], src, pub)
    assert pub.manifest() == before and len([d for d in os.listdir(f"{pub.root}/by_region") if d.startswith("gen=")]) == 1
    assert run_pipelines(spark, "t", [ByRegion], src, pub).status == "published"


def test_locks_cleanup_and_retry(spark, tmp_path):
    pub = Publisher(spark, str(tmp_path / "pub"), attempts=2, wait_seconds=0.01)
    df = spark.sql("select 1 as n")
    with pub.task_lock("t"):
        r = run_pipelines(spark, "t", [Fixed], [], pub)
        assert (r.status, r.reason) == ("skipped", "task_already_running")
    s = pub.stage(df, "fixed", "t", "r1")
    with pub._locked("manifest"), pytest.raises(Busy):
        pub.commit([s], "t", "r1")
    os.makedirs(f"{pub.root}/fixed/gen=unknown")
    assert pub.clean_up("other") == [] and pub.clean_up("t") == ["fixed/gen=r1"]
    assert os.path.isdir(f"{pub.root}/fixed/gen=unknown")
    pub.commit([], "t", "r2")
    assert pub.manifest() == {"tables": {}, "state": {}}


def test_refill_keeps_the_schema(spark, tmp_path):
    pub = Publisher(spark, str(tmp_path / "pub"))
    pub.commit([pub.stage(spark.sql("select 1 as n"), "t1", "t", "a")], "t", "a")
    s = pub.stage(spark.sql("select 'x' as n"), "t1", "t", "b", "refill")
    with pytest.raises(PublishError, match="live table's schema"):
        pub.commit([s], "t", "b")
    pub.rollback([s], "b")
    assert [r.n for r in pub.read("t1").collect()] == [1] and not os.path.exists(f"{pub.root}/t1/gen=b")
    with pytest.raises(PublishError):
        pub.read("none")


def test_two_tables_appear_at_once(spark, tmp_path):
    pub = Publisher(spark, str(tmp_path / "pub"))
    staged = [pub.stage(spark.sql(f"select {i} as n"), f"t{i}", "t", "a") for i in (1, 2)]
    with pytest.raises(PublishError):
        pub.read("t1")
    pub.commit(staged, "t", "a", {"s": {"signature": "x"}})
    with open(f"{pub.root}/_MANIFEST.json", encoding="utf-8") as f:
        m = json.load(f)
    assert set(m["tables"]) == {"t1", "t2"} and m["state"]["t"]["s"]["signature"] == "x"


def test_specs_are_checked_first(spark, tmp_path):
    pub = Publisher(spark, str(tmp_path / "pub"))
    with pytest.raises(SpecError, match="no source"):
        run_pipelines(spark, "t", [ByRegion], [], pub)
    with pytest.raises(SpecError):
        run_pipelines(spark, "t", [ByRegion], [custom("sales", lambda e: None)] * 2, pub)
    with pytest.raises(SpecError):
        run_pipelines(spark, "t", [Fixed], [])
    with pytest.raises(PublishError):
        run_pipelines(spark, "t", [Fixed, type("Other", (Fixed,), {})], [], pub)
    for bad in ({"strategy": "refill", "table": "t"}, {"updated_at": "x"}, {"table": "t", "schema": (), "contract": Contract({})}):
        with pytest.raises(SpecError):
            Output(**bad)


def test_unused_sources_are_never_opened(spark, tmp_path):
    opened = []
    sources = [custom("sales", lambda e: e.spark.sql("select 'a' as `Регион`, '1' as `Сумма`")), custom("other", lambda e: opened.append(1))]
    assert run_pipelines(spark, "t", [ByRegion], sources, Publisher(spark, str(tmp_path / "p"))).status == "published" and not opened


def test_file_sets_are_tracked(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_text("Регион;Сумма\nЮг;1\n", encoding="utf-8")
    pub = Publisher(spark, str(tmp_path / "pub"))
    go = lambda: run_pipelines(spark, "t", [ByRegion], [csv_file_set("sales", "in")], pub, base_path=str(tmp_path)).status
    assert go() == "published" and go() == "skipped"
    (tmp_path / "in" / "b.csv").write_text("Регион;Сумма\nЮг;2\n", encoding="utf-8")
    assert go() == "published" and pub.read("by_region").first().total == 3
