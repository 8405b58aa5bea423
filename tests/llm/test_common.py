from __future__ import annotations

import subprocess
import sys

from pyspark import cloudpickle

from conftest import dicts
from sprintloom.llm import common, decontamination, gru, language_id, recurrent_lm


def test_most_frequent_divides_a_step_of_equal_counts(spark):
    """Equal counts beyond the bound are kept in part, the same part each time."""
    rows = spark.createDataFrame([(f"w{i}", 7) for i in range(3000)] + [(f"x{i}", 50) for i in range(100)] + [("none", 0)], "word string, n long")
    one, two = ({r["word"] for r in dicts(common.most_frequent(rows.repartition(n), "n", 1100, "word"))} for n in (2, 3))
    assert one == two and 700 < len(one) <= 1100 and {f"x{i}" for i in range(100)} <= one and "none" not in one
    assert common.most_frequent(rows, "n", 5000, "word").count() == 3100
    assert common.most_frequent(rows.filter("false"), "n", 5, "word").count() == 0


def test_most_frequent_gives_each_group_its_share(spark):
    rows = spark.createDataFrame([("en", f"w{i}", 10_000 - i) for i in range(900)] + [("es", f"v{i}", 3) for i in range(40)] + [(None, "q", 99)], "lang string, word string, n long")
    taken = dicts(common.most_frequent(rows, "n", 100, "word", "lang"))
    assert sum(r["lang"] == "es" for r in taken) == 40 and 50 < sum(r["lang"] == "en" for r in taken) <= 100 and len(taken) <= 140


def test_join_groups_loses_and_repeats_nothing(spark):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 2500}" if i % 7 else None, i) for i in range(9000)], "k string, i long")
    groups = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n").withColumn("size", common.F.col("n"))
    met = dicts(common.join_groups(rows, groups, "k", common.F.col("i")))
    sizes = {r["k"]: r["n"] for r in dicts(groups)}
    assert sorted(r["i"] for r in met) == list(range(9000)) and all(r["size"] == sizes.get(r["k"]) for r in met)
    assert sorted(met[0]) == ["i", "k", "size"]


def test_what_is_shipped_needs_no_installed_package(tmp_path):
    """A Python that does not know the package unpacks the values and uses them."""
    values = [decontamination.index([(1, "some item of a benchmark that is long enough")]),
              language_id.Model(["de", "en"], {}, gru.np.zeros((0, 2)), {}, {}),
              recurrent_lm.Model(recurrent_lm.Settings(), {b"a": 0}, gru.np.zeros(1), 1, 1, gru.Net.new(gru.np.ones(1), 1.0, 4, 2))]
    (tmp_path / "values").write_bytes(cloudpickle.dumps(values))
    script = ("import pickle, sys; v = pickle.load(open(sys.argv[1], 'rb')); assert not any('sprintloom' in p for p in sys.path); "
              "print(v[0].band, v[1].predict('12')[0], round(v[2].base_total, 3))")
    out = subprocess.run([sys.executable, "-c", script, str(tmp_path / "values")], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert out.stdout.split() == ["16", "und", "0.301"], out.stderr[-800:]
