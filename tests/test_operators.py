import datetime as dt
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from stepframe import Col, Plan
from stepframe.operators.math import math_diff_lag
from stepframe.plans.context import Context, Key


def values(df, *columns):
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return [r[0] for r in rows] if len(columns) == 1 else rows


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl).coalesce(1)


def test_column_basics(basic):
    out = Plan().col_drop(["age", "active"]).col_rename("name", "who").col_duplicate("id", "id2").transform(basic)
    assert out.columns == ["id", "who", "salary", "id2"]
    assert Plan().col_reorder(["salary", "id"]).transform(basic).columns == ["salary", "id"]


def test_names_with_dots_and_quotes(spark):
    d = frame(spark, "`a.b` bigint, `c``d` string, `e f` double", (1, "x", 2.0))
    out = Plan().math_add("a.b", 1).str_upper("c`d").math_divide("e f", 4).col_rename("a.b", "x.y").rows_filter(Col("x.y") == 2).transform(d)
    assert out.columns == ["x.y", "c`d", "e f"] and values(out) == [(2, "X", 0.5)]


@pytest.mark.parametrize(("strategy", "expected"), [("forward", [25, 30, 30, 40, 45]), ("backward", [25, 30, 40, 40, 45]), ("min", [25, 30, 25, 40, 45]), ("max", [25, 30, 45, 40, 45]), ("zero", [25, 30, 0, 40, 45]), ("mean", [25, 30, 35, 40, 45])])
def test_fill_null(with_nulls, strategy, expected):
    out = Plan().col_fill_null("age", strategy=strategy).rows_sort("id").transform(with_nulls)
    assert values(out, "age") == expected


def test_fill_across_partitions(spark):
    d = spark.range(0, 100, 1, 7).select("id", F.when(F.col("id") % 30 == 0, F.col("id")).alias("v"))
    out = values(Plan().col_fill_null("v", strategy="forward").rows_sort("id").transform(d, order_by="id"), "v")
    assert out == [i - i % 30 for i in range(100)]
    out = values(Plan().rows_sort("id", descending=True).col_fill_null("v", strategy="forward").rows_sort("id").transform(d), "v")
    assert out == [-(-i // 30) * 30 if i <= 90 else None for i in range(100)]


def test_cast_unsigned(spark):
    d = frame(spark, "a bigint", (1,), (None,), (255,))
    assert values(Plan().col_cast("a", "UInt8").transform(d), "a") == [1, None, 255]
    with pytest.raises(Exception, match="out of range"):
        Plan().col_cast("a", "UInt8").transform(frame(spark, "a bigint", (256,))).collect()
    with pytest.raises(ValueError, match="Unknown dtype name"):
        Plan().col_cast("a", "Nope")


def test_hash_and_uuid(with_nulls):
    import hashlib

    out = Plan().col_hash(["id", "name"], "h", salt="s").rows_sort("id").transform(with_nulls)
    assert values(out, "h")[1] == hashlib.sha256(b"2|s").hexdigest()[:16]
    ids = values(Plan().col_add_uuid("u", 20).transform(with_nulls), "u")
    assert len(set(ids)) == 5 and all(len(x) == 20 for x in ids)


def test_division_follows_ieee(spark):
    d = frame(spark, "a double, b double", (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (3.0, 2.0))
    got = values(Plan().math_divide_columns("a", "b", "q").transform(d), "q")
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, 1.5]


def test_logarithms(spark):
    d = frame(spark, "a double", (0.0,), (-1.0,), (1.0,), (None,))
    got = values(Plan().math_log("a", new_column="l").transform(d), "l")
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2:] == [0.0, None]


def test_clamp_keeps_null(with_nulls):
    assert values(Plan().math_clamp("age", 30, 40).rows_sort("id").transform(with_nulls), "age") == [30, 30, None, 40, 40]


def test_round_ties(spark):
    d = frame(spark, "a double", (0.5,), (-0.5,), (1.25,), (2.5,))
    assert values(Plan().math_round("a").transform(d), "a") == [1.0, -1.0, 1.0, 3.0]


@pytest.mark.parametrize(("method", "expected"), [("ordinal", [1, 2, 3, 4]), ("dense", [1, 2, 2, 3]), ("min", [1, 2, 2, 4]), ("max", [1, 3, 3, 4]), ("average", [1.0, 2.5, 2.5, 4.0])])
def test_rank(spark, method, expected):
    d = frame(spark, "v bigint", (1,), (2,), (2,), (3,), (None,))
    assert values(Plan().math_rank("v", "r", method).rows_sort("v").transform(d), "r") == [None, *expected]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("method", ["ordinal", "dense", "min", "max", "average", "random"])
def test_rank_of_all_rows(spark, method, descending):
    d = spark.range(0, 200, 1, 5).select("id", F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 40).alias("v"), F.lit(1).alias("one"))
    ungrouped, grouped = (values(Plan().math_rank("v", "r", method, descending=descending, group_by=g).rows_sort("id").transform(d, order_by="id"), "v", "r") for g in (None, "one"))
    assert sorted(ungrouped, key=str) == sorted(grouped, key=str) if method == "random" else ungrouped == grouped


def test_cumsum(spark):
    d = frame(spark, "g string, v bigint", ("A", 1), ("A", None), ("A", 3), ("B", 4), (None, 5))
    assert values(Plan().math_cumsum("v", "s", group_by="g").rows_sort(["g", "v"]).transform(d), "g", "s") == [(None, 5), ("A", None), ("A", 1), ("A", 4), ("B", 4)]
    wide = spark.range(0, 50, 1, 6)
    assert values(Plan().math_cumsum("id", "s").rows_sort("id").transform(wide), "s") == [i * (i + 1) // 2 for i in range(50)]
    assert values(Plan().rows_sort("id", descending=True).math_cumsum("id").transform(wide), "id")[:3] == [49, 97, 144]


def test_lag_sorts(spark):
    d = frame(spark, "seq bigint, v bigint", (3, 30), (1, 10), (2, 25))
    assert values(Plan().math_diff_lag("v", order_by="seq", new_column="d").transform(d), "seq", "d") == [(1, None), (2, 15), (3, 5)]


def test_diff_from_agg_of_times(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in (0, 2, 6)]
    d = frame(spark, "t timestamp_ntz", *[(x,) for x in t])
    got = values(Plan().math_diff_from_agg("t", "min", "a").math_diff_from_agg("t", "median", "m").rows_sort("t").transform(d), "a", "m")
    assert got == [(dt.timedelta(hours=a), dt.timedelta(hours=m)) for a, m in ((0, -2), (2, 0), (6, 4))]


def test_scaling_of_constants_and_nulls(spark):
    d = frame(spark, "a double", (2.0,), (2.0,), (None,))
    out = Plan().math_standardize("a", new_column="z").math_minmax("a", new_column="m").math_robust_scale("a", new_column="r").transform(d)
    assert values(out, "z", "m", "r") == [(0.0, 0.5, 0.0)] * 3
    d = frame(spark, "a double", (1.0,), (2.0,), (3.0,), (None,))
    assert values(Plan().math_standardize("a").transform(d), "a") == [-1.0, 0.0, 1.0, None]


def test_winsorize(spark):
    d = spark.range(1, 12).select(F.col("id").cast("double").alias("a")).coalesce(1)
    assert values(Plan().math_winsorize("a", lower=0.1, upper=0.9).transform(d), "a") == [2.0, 2.0, *map(float, range(3, 10)), 10.0, 10.0]


def test_head_tail_sort(basic):
    assert values(Plan().rows_sort("age", descending=True).rows_head(2).transform(basic), "id") == [5, 4]
    assert values(Plan().rows_tail(2).transform(basic), "id") == [4, 5]
    assert values(Plan().rows_sort("name").math_rank("age", "r", "dense", group_by="active").transform(basic), "id") == [1, 2, 3, 4, 5]


def test_sort_places_nulls_first(with_nulls):
    assert values(Plan().rows_sort("salary", descending=True).transform(with_nulls), "salary") == [None, None, 90000.0, 70000.0, 50000.0]


def test_unique(spark):
    d = frame(spark, "k bigint, v string", (1, "a"), (2, "b"), (1, "c"), (None, "d"), (None, "e"))
    got = {keep: values(Plan().rows_unique("k", keep=keep).rows_sort("v").transform(d), "v") for keep in ("first", "last", "none")}
    assert got == {"first": ["a", "b", "d"], "last": ["b", "c", "e"], "none": ["b"]}


def test_deduplicate_leaves_order(spark):
    d = frame(spark, "k bigint, t bigint", (2, 5), (1, 9), (2, 1), (1, 3))
    assert values(Plan().rows_deduplicate("k", "t").transform(d)) == [(2, 1), (1, 3)]
    assert values(Plan().rows_deduplicate("k", "t", keep="last", descending=True).transform(d), "k", "t") == [(1, 3), (2, 1)]


def test_explode_and_melt_keep_order(spark):
    d = frame(spark, "id bigint, x array<string>", (1, ["b", "a"]), (2, []), (3, None))
    assert values(Plan().rows_explode("x").rows_head(9).transform(d)) == [(1, "b"), (1, "a"), (2, None), (3, None)]
    d = frame(spark, "id bigint, q2 bigint, q1 bigint", (1, 1, None), (2, 3, 4))
    assert values(Plan().rows_melt(["id"], ["q2", "q1"]).rows_head(9).transform(d)) == [(1, "q2", 1), (1, "q1", None), (2, "q2", 3), (2, "q1", 4)]


def test_pivot(spark):
    d = frame(spark, "id bigint, q string, v bigint", (1, "Q2", 5), (1, "Q1", 1), (1, "Q1", 2), (2, "Q1", 3))
    assert Plan().rows_pivot("id", "q", "v", "count").transform(d).sort("id").collect() == [(1, 2, 1), (2, 1, 0)]
    assert Plan().rows_pivot("id", "q", "v").transform(d).sort("id").collect() == [(1, 1, 5), (2, 3, None)]


def test_sample(basic):
    a, b = (values(Plan().rows_sample(fraction=0.4, seed=1).transform(d), "id") for d in (basic, basic.repartition(3)))
    assert len(a) == 2 and sorted(a) == sorted(b)


def test_strings(spark):
    d = frame(spark, "s string", (" \tÄb c\n",), (None,), ("",))
    out = Plan().str_strip("s").str_upper("s").str_pad("s", 6, "*", "right").transform(d)
    assert values(out, "s") == ["ÄB C**", None, "******"]
    assert values(Plan().str_slice("s", -3).transform(frame(spark, "s string", ("hello",), ("a",))), "s") == ["llo", "a"]
    assert values(Plan().str_truncate("s", 5).transform(frame(spark, "s string", ("hello world",), ("short",))), "s") == ["he...", "short"]
    assert values(Plan().str_replace("s", r"(\w)(\d)", "${2}$1$", literal=False).transform(frame(spark, "s string", ("a1.b2",))), "s") == ["1a$.2b$"]
    assert values(Plan().str_split("s", ".").transform(frame(spark, "s string", ("a.b",))), "s") == ["a", "b"]
    assert values(Plan().str_extract("s", r"\d+", 0).transform(frame(spark, "s string", ("a12",), ("x",))), "s") == ["12", None]


def test_dates(spark):
    t = dt.datetime(2021, 1, 1, 23, 59, 59)
    d = frame(spark, "t timestamp_ntz", (t,), (None,))
    out = Plan().dt_calendar_week("t", "w").dt_quarter_year("t", "q").dt_truncate("t", "2w", "tt").dt_format("t", "100%% at %I%p", "f").transform(d)
    assert values(out, "w", "q", "f") == [("2020-W53", "Q1-2021", "100% at 11PM"), (None, None, None)]
    assert values(out, "tt")[0].weekday() == 0
    assert values(Plan().dt_parse("s", "%d.%m.%Y").transform(frame(spark, "s string", ("3.2.2024",), ("x",))), "s") == [dt.date(2024, 2, 3), None]
    d = frame(spark, "a timestamp_ntz, b timestamp_ntz", (dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 1, 23)), (dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 8)))
    assert values(Plan().dt_diff_days("a", "b", "d").dt_age_years("b", "a", "y").transform(d), "d", "y") == [(0, 0), (-372, -2)]
    with pytest.raises(ValueError, match="directive"):
        Plan().dt_parse("s", "%Q")


def test_mappings(spark):
    d = frame(spark, "k bigint", (1,), (2,), (None,))
    assert values(Plan().map_values("k", {1: "one"}).transform(d), "k") == ["one", "2", None]
    big = {i: i + 1 for i in range(2000)}
    assert values(Plan().map_values("k", big, default=0, keep_unmapped=False).rows_sort("k").transform(d), "k") == [0, 2, 3]
    assert values(Plan().map_discretize("k", [1, 2]).transform(frame(spark, "k double", (1.0,), (1.5,), (3.0,), (float("nan"),))), "k") == ["(-inf, 1]", "(1, 2]", "(2, inf]", None]


def test_encodings(spark):
    d = frame(spark, "pos string", ("last",), ("first",), ("mid",), (None,))
    assert Plan().map_onehot("pos", ["last", "first", "mid"], drop="first").transform(d).columns == ["pos_last", "pos_mid"]
    assert values(Plan().map_onehot("pos", ["last", "mid"], unknown_value="ignore").transform(d)) == [(1, 0), (None, None), (0, 1), (None, None)]
    assert values(Plan().map_ordinal("pos").transform(d), "pos") == [1, 0, 2, -1]
    assert Plan().map_ordinal("pos", new_column="x").transform(d).columns == ["x"]


def test_from_column_takes_the_last(spark):
    d = frame(spark, "a bigint, k bigint, v string", (1, 1, "x"), (2, 1, None), (9, 2, "z"))
    assert values(Plan().map_from_column("a", "k", "v", "o", default="?").rows_sort("a").transform(d), "o") == [None, "z", "?"]


def test_join(spark):
    left, right = frame(spark, "id bigint, v string", (1, "a"), (2, "b"), (None, "c")), frame(spark, "id bigint, v string, w bigint", (1, "x", 5), (None, "y", 6))
    out = Plan().join("id", "r", "left").transform(left, {"r": right})
    assert out.columns == ["id", "v", "v_right", "w"] and sorted(values(out, "v", "w")) == [("a", 5), ("b", None), ("c", None)]
    with pytest.raises(ValueError, match="Reference 'r' not found"):
        Plan().join("id", "r").transform(left)


@pytest.mark.parametrize("step", [lambda p: p.rows_sort("value").rows_head(), lambda p: p.math_standardize("value"), lambda p: p.math_cumsum("value"), lambda p: p.rows_pivot("id", "name", "value", "sum"), lambda p: p.map_onehot("name"), lambda p: p.col_fill_null("value", strategy="forward"), lambda p: p.rows_sample(3), lambda p: p.math_diff_from_agg("value", "mean", "d"), lambda p: p.rows_tail(), lambda p: p.math_winsorize("value", lower=0.1), lambda p: p.map_from_column("id", "id", "name", "o"), lambda p: p.rows_deduplicate("id", "value")])
def test_empty_frames(empty, step):
    assert step(Plan()).transform(empty).count() == 0


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["normal", "skewed", "ties", "few", "nan"])
def test_quantiles_are_exact(spark, monkeypatch, kind):
    from stepframe.plans import context

    monkeypatch.setattr(context, "_FEW", 3)
    monkeypatch.setattr(context, "_CUTS", 8)
    r = random.Random(2)
    v = {
        "normal": [r.gauss(0, 1) for _ in range(500)],
        "skewed": [10.0 ** r.randint(-9, 9) for _ in range(300)] + [-1e300, 1e-300],
        "ties": [float(r.randint(0, 3)) for _ in range(300)],
        "few": [5.0, 1.0],
        "nan": [*map(float, range(20)), *[float("nan")] * 4],
    }[kind]
    d = spark.createDataFrame([(x,) for x in [*v, None]], "v double").repartition(3)
    asked = [0.0, 0.03, 0.1, 0.5, 0.77, 0.95, 1.0]
    want = d.agg(F.percentile("v", F.array(*[F.lit(q) for q in asked]))).first()[0]
    got = context.Context().quantiles(d, "x", "v", **{f"q{i}": q for i, q in enumerate(asked)})
    assert str(list(got.values())) == str(want)
    assert context.Context().quantiles(d.limit(0), "x", "v", a=0.5) == {"a": None}


@pytest.mark.parametrize("order", ["id bigint", "id string", "id decimal(12,2)", "id date"])
@pytest.mark.parametrize("lag", [1, 3, 40])
def test_lag_over_ranges(spark, order, lag):
    kind = order.split(" ")[1]
    key = {"bigint": lambda i: i, "string": lambda i: f"{i:04d}", "decimal(12,2)": lambda i: decimal.Decimal(i), "date": lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)}[kind]
    rows = [(key(i), i * i) for i in range(60)]
    r = random.Random(lag)
    d = spark.createDataFrame(r.sample(rows, 60), f"{order}, v bigint").repartition(3)
    out = Plan().math_diff_lag("v", order_by="id", new_column="x", lag=lag).transform(d)
    assert [x.x for x in out.collect()] == [i * i - (i - lag) ** 2 if i >= lag else None for i in range(60)]


@pytest.mark.parametrize("lag", [1, 100])
def test_lag_over_ranges_spreads_rows(spark, lag):
    """Rows that look nothing up in the ranges before don't meet in one task, whether or not those are broadcast."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        d = spark.range(0, 16000, 1, 3).select((F.col("id") * 7919 % 16000).alias("id"))
        ctx = Context(order=[Key("id")])
        out = math_diff_lag(d, ctx, "id", "id", "x", lag=lag)
        n = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(n) == 16000 and max(n) < 8000
        assert out.where(F.col("x") == lag).count() == 16000 - lag and out.where("x IS NULL").count() == lag
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "timestamp"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("n", [1, 2, 3, 8, 100])
def test_ranges_follow_the_order(spark, kind, descending, n):
    r = random.Random(n)
    d = spark.createDataFrame([(r.choice([None, r.randint(-50, 50)]),) for _ in range(400)], "v bigint").select(F.col("v").cast(kind).alias("v"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        bucket = Context().ranges(d, "v", descending, nulls_first=True)
        plan = physical(d.select(bucket))
        assert plan.count(" > ") + plan.count(" < ") <= 4  # bisection, however many ranges; not a comparison with each bound
        by = F.col("v").desc_nulls_first() if descending else F.col("v").asc_nulls_first()
        got = [tuple(x) for x in d.select("v", bucket.alias("b")).orderBy(by).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [b for _, b in got] == sorted(b for _, b in got) and len(dict(got)) == len(set(got))
    assert len({b for _, b in got}) >= min(n, 20)


@pytest.mark.parametrize("kind", ["string", "decimal(10,1)", "boolean"])
@pytest.mark.parametrize("method", ["dense", "min", "average"])
def test_rank_of_any_type_by_ranges(spark, kind, method):
    r = random.Random(3)
    d = spark.createDataFrame([(i, r.choice([None, r.randint(0, 30)]), "g") for i in range(200)], "id bigint, n bigint, g string").withColumn("v", F.col("n").cast(kind))
    one, many = (Plan().math_rank("v", "r", method, group_by=g).transform(d) for g in (None, "g"))
    assert sorted(map(str, one.select("id", "r").collect())) == sorted(map(str, many.select("id", "r").collect()))


def test_samples_are_filters(spark):
    d = spark.range(5000).withColumn("v", F.col("id") % 7).repartition(4)
    out = Plan().rows_sample(fraction=0.3, seed=5).transform(d)
    assert out.count() == 1500 and out.distinct().count() == 1500
    assert "TakeOrdered" not in physical(out) and "SinglePartition" not in physical(out)
    assert sorted(out.collect()) == sorted(Plan().rows_sample(n=1500, seed=5).transform(d.repartition(2)).collect())
    equal = spark.range(1000).select(F.lit(1).alias("a"), (F.col("id") % 2).alias("b")).repartition(3)
    for n in (0, 1, 499, 500, 501, 777, 1000, 2000):
        got = Plan().rows_sample(n=n, seed=1).transform(equal)
        assert got.count() == min(n, 1000) and got.columns == ["a", "b"]


@pytest.mark.parametrize("agg", ["sum", "mean", "min", "max", "count", "median"])
def test_differences_from_groups(spark, agg):
    d = spark.createDataFrame([("a", None, 1), ("a", None, 4), ("b", 1, 5), (None, 1, None), (None, 1, 7)], "g string, h int, v int")
    got = {(r.g, r.h, r.v): r.x for r in Plan().math_diff_from_agg("v", agg, "x", group_by=["g", "h"]).transform(d).collect()}
    f = {"sum": sum, "mean": lambda x: sum(x) / len(x), "min": min, "max": max, "count": len, "median": lambda x: sorted(x)[len(x) // 2] if len(x) % 2 else sum(x) / len(x)}[agg]
    of = {("a", None): [1, 4], ("b", 1): [5], (None, 1): [7]}
    assert got == {k: None if k[2] is None else k[2] - f(of[k[:2]]) for k in got} and len(got) == 5
