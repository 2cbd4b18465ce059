import datetime as dt
import decimal
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepframe import Col, Filter, Plan, SchemaValidationError, frame_hash
from stepframe.registry import REGISTRY
from stepframe.streaming import check_streamable


def test_registry_is_complete():
    count = lambda *p: sum(n.startswith(p) for n in REGISTRY)
    assert (count("col_"), count("math_"), count("rows_"), count("str_"), count("dt_"), count("map_"), count("join")) == (14, 25, 13, 10, 14, 10, 1)
    assert all(hasattr(Plan, n) and op.lower.__doc__ for n, op in REGISTRY.items())


def sample():
    return (
        Plan()
        .section("clean")
        .rows_filter((Col("age") >= 30) & ~Col("name").is_in(["x'y", 'q"']))
        .because('it\'s "needed"')
        .map_values("id", {1: "a", None: "b"})
        .section(None)
        .map_case("name", [("Bob", dt.date(2024, 1, 2)), ("Eve", dt.date(2024, 3, 4))], new_column="d")
        .col_add("x", value=decimal.Decimal("1.5"))
        .math_minmax("salary", feature_range=(0, 2))
        .math_clamp("salary", upper=float("inf"))
    )


def test_json_round_trip(tmp_path):
    plan = sample()
    assert Plan.from_json(plan.to_json()) == plan
    plan.to_json(tmp_path / "p.json")
    assert Plan.from_json(tmp_path / "p.json") == plan
    assert json.loads(plan.to_json())["version"] == "1.0"


def test_code_round_trip():
    scope = {}
    exec(sample().to_python("p"), scope)
    assert scope["p"] == sample()


def test_only_operators_are_called(tmp_path):
    bad = {"version": "1.0", "steps": [{"operation": "to_json", "params": {"path": str(tmp_path / "x")}}]}
    with pytest.raises(ValueError, match="Unknown operation: to_json"):
        Plan.from_dict(bad)
    assert not (tmp_path / "x").exists()
    with pytest.raises(ValueError, match="Invalid parameters for operation 'col_drop'"):
        Plan.from_dict({"steps": [{"operation": "col_drop", "params": {"nope": 1}}]})


def test_composition(basic):
    block = Plan().section("b").col_drop("age").math_add(["id"], 1)
    assert [s.section for s in (Plan().section("a").col_drop("name") + block).steps] == ["a", "b", "b"]
    assert len(Plan().pipe(lambda p, n: p.math_add(["id", "age"], n), 2)) == 2
    with pytest.raises(ValueError, match="because"):
        Plan().because("x")
    assert [s.reason for s in Plan().math_add(["id", "age"], 1).because("r").steps] == ["r", "r"]


leaf = st.one_of(
    st.builds(lambda c, v: Filter("eq", column=c, value=v), st.text(), st.one_of(st.integers(), st.text(), st.none(), st.booleans(), st.dates())),
    st.builds(lambda c, a, b: Filter("between", column=c, lower=a, upper=b), st.text(), st.datetimes(), st.datetimes()),
    st.builds(lambda c, v: Filter("is_in", column=c, values=v), st.text(), st.lists(st.integers())),
)
trees = st.recursive(leaf, lambda t: st.one_of(st.builds(lambda a, b: a & b, t, t), st.builds(lambda a: ~a, t)), max_leaves=6)


@settings(max_examples=100, deadline=None)
@given(trees)
def test_any_filter_survives_json(tree):
    plan = Plan().rows_filter(tree)
    assert Plan.from_json(plan.to_json()) == plan


def test_filter_errors():
    with pytest.raises(ValueError, match="Missing 'type'"):
        Filter.from_dict({})
    with pytest.raises(ValueError, match="Unknown filter type"):
        Filter.from_dict({"type": "x"})
    with pytest.raises(TypeError):
        bool(Col("a") == 1)


@pytest.mark.parametrize(
    ("plan", "message"),
    [
        (Plan().col_drop("nope"), "Step 1 (col_drop): Column 'nope' does not exist"),
        (Plan().col_rename("id", "name"), "Column 'name' already exists"),
        (Plan().math_add("name", 1), "Column 'name' is string, expected numeric"),
        (Plan().str_lower("id"), "Column 'id' is bigint, expected string"),
        (Plan().dt_year("name"), "expected date/datetime"),
        (Plan().rows_filter(Col("name") > 3), "cannot use numeric comparison"),
        (Plan().rows_filter(Col("id").str_contains("x")), "cannot use string filter"),
        (Plan().rows_explode("name"), "expected List"),
        (Plan().rows_deduplicate("id", "x"), "Sort column 'x' does not exist"),
        (Plan().math_cumsum("id", group_by="g"), "Group-by columns do not exist"),
        (Plan().rows_melt(["q"], ["id"]), "ID columns"),
        (Plan().map_onehot("name", ["a", "a"]), "names a value more than once"),
        (Plan().map_onehot("name", ["a"], drop="b"), "Drop value 'b' not in categories list"),
        (Plan().col_expr("x", "nothing + 1"), "nothing"),
    ],
)
def test_validation(basic, plan, message):
    assert message in str(plan.validate(basic))
    with pytest.raises(SchemaValidationError):
        plan.process(basic)


def test_validation_tracks_schemas(basic):
    assert Plan().col_add("c", value=1000).math_add("c", 1).dt_parse("name", new_column="d").dt_year("d").col_rename("age", "years").math_add("years", 1).validate(basic).is_valid
    assert Plan().rows_pivot("id", "name", "age").math_add("Alice", 1).validate(basic).is_valid  # columns depend on data
    run = Plan().col_drop("age").col_cast("id", "String").dry_run(basic)
    assert run.steps[0].columns_removed == ["age"] and run.steps[1].columns_modified == ["id"] and run.is_valid
    assert "col_cast" in run.summary()


def test_errors_do_not_stop_validation(basic):
    assert len(Plan().col_drop("a").col_drop("b").col_drop("age").validate(basic).errors) == 2


@pytest.mark.parametrize("plan", [Plan().rows_filter(Col("age") > 26).math_add("age", 1), Plan().rows_filter(Col("age") > 26).rows_sort("age").rows_head(2), Plan().rows_sort("age").col_drop("name").rows_tail(3).math_cumsum("age"), Plan().math_standardize("salary").rows_sample(2, seed=1), Plan().rows_pivot("active", "name", "age", "sum").rows_unique(keep="any"), Plan()])
def test_audit_counts_what_is_there(basic, plan):
    out, protocol = plan.process(basic)
    assert protocol.input_shape == (5, 5) and protocol.input_hash == frame_hash(basic)
    for k, s in enumerate(protocol.steps, 1):
        part = Plan()
        part._steps = list(plan.steps[:k])
        frame = part.transform(basic)
        assert s["output_shape"] == [frame.count(), len(frame.columns)]
        assert s["output_hash"] == frame_hash(frame)
    assert protocol.output_hash == frame_hash(out)


def test_hash_properties(spark, basic):
    h = frame_hash(basic)
    assert len(h) == 16 and h == frame_hash(basic.select(*reversed(basic.columns)).repartition(3))
    assert frame_hash(basic.union(basic)) != h
    a, b = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert frame_hash(a) != frame_hash(b)
    assert frame_hash(Plan().col_rename("id", "x").col_rename("x", "id").transform(basic)) == h


def test_protocol_output(spark, basic, tmp_path):
    from stepframe import Protocol

    _, protocol = Plan().section("s").rows_filter(Col("id") > 0).because("all").math_standardize("salary").process(basic)
    assert protocol.steps[0]["changed"] is False and "○" in protocol.summary()
    assert protocol.derived["math_standardize(salary)"]["mean"] == 70000
    assert Protocol.from_json(protocol.to_json(tmp_path / "p.json")).to_dict() == json.loads(protocol.to_json())
    assert protocol.to_csv().count("\n") == 3 and protocol.to_dataframe(spark).count() == 2
    assert protocol.sections()[0]["steps"] == 2


def test_audit_levels(basic):
    for level, known in (("shape", False), ("endpoints", True), ("none", False)):
        _, p = Plan().math_add("id", 1).process(basic, audit=level)
        assert (p.output_hash is not None) == known
    with pytest.raises(ValueError, match="audit"):
        Plan().process(basic, audit="x")


@pytest.mark.parametrize(
    ("plan", "key", "ok"),
    [
        (Plan().rows_unique(["a", "b"]), "a", True),
        (Plan().rows_unique("a"), ["a", "b"], False),
        (Plan().rows_unique("a"), "a", True),
        (Plan().rows_unique("a"), None, False),
        (Plan().col_rename("a", "z").math_cumsum("v", group_by="z"), "a", True),
        (Plan().math_add("a", 1).rows_unique("a"), "a", False),
        (Plan().rows_sort("a"), "a", False),
        (Plan().math_cumsum("v"), "a", False),
        (Plan().math_standardize("v"), "a", False),
        (Plan().math_standardize("v", mean=0, std=1).map_null_to_value("v", 0), None, True),
    ],
)
def test_chunk_rules(plan, key, ok):
    assert plan.validate_chunked(key).is_valid == ok


def test_chunks(spark, tmp_path):
    rows = [("a", i, i) for i in range(5)] + [("b", i, i) for i in range(3)] + [(None, i, i) for i in range(2)]
    d = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    d.write.parquet(str(tmp_path / "x"))
    plan = Plan().math_cumsum("v", "run", group_by="k").rows_filter(Col("v") > 0)
    out, protocol = plan.process_chunked(tmp_path / "x", partition_key="k", chunk_size=4)
    assert frame_hash(out) == frame_hash(plan.transform(spark.read.parquet(str(tmp_path / "x"))))
    assert protocol.total_input_rows == 10 and protocol.total_output_rows == 7 and protocol.num_chunks >= 2
    out, protocol = Plan().math_add("v", 1).process_chunked(d.coalesce(1), chunk_size=4)
    assert [c.input_rows for c in protocol.chunks] == [4, 4, 2]
    out, _ = Plan().rows_head(3).process_chunked(d.coalesce(1), chunk_size=4, strict_chunking=False)
    assert [r.v for r in out.collect()] == [0, 1, 2]
    out, protocol = Plan().col_drop("v").process_chunked(d.limit(0))
    assert out.columns == ["k", "t"] and out.count() == 0
    with pytest.raises(FileNotFoundError, match="Source file not found"):
        Plan().process_chunked(tmp_path / "none")


def test_streams_take_row_wise_plans():
    assert check_streamable(Plan().math_add("a", 1).rows_filter(Col("a") > 1)) == []
    assert len(check_streamable(Plan().rows_sort("a").rows_unique("a").math_cumsum("a", group_by="b"))) == 3


def test_sources(spark, basic, tmp_path):
    from stepframe.sources import read_table, write_table

    for kind in ("parquet", "orc", "csv", "json"):
        write_table(basic, f"{tmp_path}/t.{kind}")
        assert frame_hash(read_table(spark, f"{tmp_path}/t.{kind}", schema=basic.schema).select(*basic.columns)) == frame_hash(basic)
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, f"{tmp_path}/t.csv")
    with pytest.raises(ValueError, match="format"):
        read_table(spark, "x.foo")


def test_results_are_objects(basic, spark, tmp_path):
    plan = Plan().col_drop("nope").rows_filter(Col("age") > 26).math_add("name", 1)
    found = plan.validate(basic)
    assert [(e.step, e.operation) for e in found.errors] == [(1, "col_drop"), (3, "math_add")] and str(found.errors[1]).startswith("Step 3 (math_add): ")
    with pytest.raises(SchemaValidationError, match="2 error"):
        found.raise_if_invalid()
    run = Plan().col_drop("age").math_multiply("salary", 2).dry_run(basic)
    assert run.input_columns == basic.columns and run.output_columns == [c for c in basic.columns if c != "age"]
    assert run.input_schema["salary"] == "double" and run.steps[1].params["value"] == 2 and run.steps[1].step == 2
    assert "value=2" in run.summary() and "value=2" not in run.summary(show_params=False) and "bigint" in run.summary(show_schema=True)
    assert Plan().dry_run(basic).output_columns == basic.columns


def test_protocols_show_parameters(basic):
    _, protocol = Plan().rows_filter(Col("age") > 26).math_add("age", 7).process(basic)
    assert "value=7" in protocol.summary() and "value=7" not in protocol.summary(show_params=False)
    assert "26" in protocol.summary() and "\n" not in protocol.to_json(indent=None)


def test_chunked_protocols(basic):
    from stepframe import ChunkedProtocol, ChunkingError

    _, protocol = Plan().rows_filter(Col("age") > 26).process_chunked(basic, chunk_size=2)
    protocol.set_metadata(run="r1")
    back = ChunkedProtocol.from_json(protocol.to_json(indent=None))
    assert back.to_dict() == protocol.to_dict() and back.metadata == {"run": "r1"} and len(back) == 3
    assert back.output_hash() == protocol.output_hash() and len(back.output_hash()) == 16 and ChunkedProtocol().output_hash() == ""
    assert [(c.chunk_index, c.input_rows, c.output_rows) for c in back.chunks] == [(0, 2, 1), (1, 2, 2), (2, 1, 1)]
    with pytest.raises(ChunkingError) as error:
        Plan().rows_sort("age").math_cumsum("age", group_by="id").process_chunked(basic)
    assert error.value.validation_result.global_operations == ["rows_sort"]
    assert error.value.validation_result.group_dependent_ops == [("math_cumsum", ["id"])]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from stepframe.streaming import stream_table

    spark.range(10).write.parquet(f"{tmp_path}/in")
    plan = Plan().math_multiply("id", 2)
    assert stream_table(spark, plan, f"{tmp_path}/in", f"{tmp_path}/work").count() == 10
    spark.range(10, 15).write.mode("append").parquet(f"{tmp_path}/in")
    assert {r.id for r in stream_table(spark, plan, f"{tmp_path}/in", f"{tmp_path}/work").collect()} == {2 * i for i in range(15)}


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    from stepframe.sources import shared_folder

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert shared_folder(Session()).startswith("file://")
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_entry_does_not_hide_errors(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    if entry._llm() == ({}, {}):
        pytest.skip("no corpus operators here")
    real = builtins.__import__

    def broken(missing):
        def load(name, *args, **kwargs):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *args, **kwargs)

        return load

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(builtins, "__import__", broken("xxhash"))
    assert entry._llm() == ({}, {}) and len(entry.queries()) > 100
    monkeypatch.setattr(builtins, "__import__", broken("stepframe.llm.gone"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
