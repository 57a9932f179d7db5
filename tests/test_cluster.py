"""Queries where tasks run in other processes than the driver's."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark

from ledgerflow import queries

RUN = """
import json, sys
from ledgerflow import queries
from ledgerflow.plans import JdbcPublisher
from ledgerflow.queries_io import _database
from ledgerflow.session import session

spark = session("tests", "local-cluster[2,1,1024]", **{"spark.ui.enabled": "false", "spark.executor.memory": "1g", "spark.sql.shuffle.partitions": "4"})
out = {q: sorted(map(list, queries.QUERIES[q](spark, "/root/testdata/sf0.001").collect())) for q in sys.argv[1:]}
kinds = spark.sql("select id, cast(id as smallint) s, id / 4 f, cast(id as decimal(9, 2)) d, id > 9 b, date'1999-12-31' d1, timestamp'2000-01-01 01:02:03.5' t, "
                  "timestamp_ntz'2000-03-26 02:30:00' n, if(id = 1, null, X'00ff') x, if(id = 2, null, 'ю') v from range(2500)").repartition(3)
p = JdbcPublisher(spark, _database(spark))
p.commit([staged := p.stage(kinds, "kinds", "r1", types="v VARCHAR(9)")], "task")
back = p.read("kinds")
out["rows"] = [staged.rows, back.count(), kinds.exceptAll(back.select([back[c].cast(k) for c, k in kinds.dtypes])).count()]
print(json.dumps(out))
"""


def test_embedded_databases_of_the_driver(tmp_path):
    home = tmp_path / "home"  # workers write below it
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(Path(__file__).parent.parent), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", RUN, "jdbc_scan", "jdbc_publish"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
    got, c = json.loads(run.stdout.splitlines()[-1]), duckdb.connect()
    for t in ("region", "nation"):
        c.sql(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for q in ("jdbc_scan", "jdbc_publish"):
        assert got[q] == sorted(map(list, c.sql(queries.ORACLES[q]).fetchall()))
    assert got["rows"] == [2500, 2500, 0]
