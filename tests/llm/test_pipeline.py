"""The pipeline's stages against brute force on the small table."""

import re
from collections import Counter

import pytest
from test_contracts import WORD, brute_components, lower

import corpus_pipeline as cp
from stepframe.llm._shared import materialize


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    for df in stages[:-1]:
        assert df.columns == cp.COLUMNS


def test_texts_without_language_go(spark, small, stages):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    after = by_id(stages[0])
    letters = {i for i, r in rows.items() if any(map(str.isalpha, r.text or ""))}
    assert set(after) <= letters and len(letters - set(after)) <= 0.01 * len(letters)
    assert sum(after[i].lang == rows[i].lang for i in after if rows[i].lang) >= 0.95 * len(after)


def test_predicted_language_decides(spark, monkeypatch):
    words = {"aa": "ba be bi bo bu", "zz": "xox zuz kak wow qaq", "cc": "mim non lul pip"}
    rows = [(i, " ".join(words[x].split() * 6), x, "s", 100) for i in range(120) for x in [list(words)[i % 3]]]
    rows += [(1000, " ".join(words["zz"].split() * 6), None, "s", 100), (1001, "\u6f22\u5b57" * 40, None, "s", 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = by_id(cp.identify_language(spark, docs, ""))
    assert got[1000].lang == "zz" and all(got[i].lang == r[1] for i, *r in rows[:120])
    monkeypatch.setattr(cp, "OVER_CHANCE", 3.0)  # only full certainty will do
    assert len(by_id(cp.identify_language(spark, docs, ""))) < len(got)


def test_shared_lines_go(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    key = lambda line: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    holders = {}
    for i, r in before.items():
        for k in {key(x) for x in r.text.split("\n")}:
            holders.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    assert set(before) == set(after)
    for i, r in before.items():
        text = "\n".join(x for x in r.text.split("\n") if gone.get(key(x), i) == i)
        assert (after[i].text, after[i].n_chars) == (text, len(text))


def test_one_of_each_group_stays(stages):
    before = by_id(stages[1])
    groups = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
    assert set(by_id(stages[2])) == {i for i, (_, root) in groups.items() if root == i}


def test_mix_repeats_whole_documents(stages):
    before, after = by_id(stages[2]), stages[3].collect()
    times = Counter(r.doc_id for r in after)
    assert max(times.values()) <= 3 and all(r.text == before[r.doc_id].text for r in after)
    total = sum(len(WORD.findall(r.text)) for r in before.values())
    assert sum(len(WORD.findall(r.text)) for r in after) == pytest.approx(total, rel=0.1)


def test_every_word_is_packed(stages):
    want, got = Counter(), Counter()
    for r in stages[3].collect():
        want[r.doc_id] += len(WORD.findall(r.text))
    bins = {}
    for r in stages[4].collect():
        got[r.doc_id] += r.piece_len
        bins.setdefault(r.bin_id, []).append(r)
    assert want == got
    for pieces in bins.values():
        assert sum(p.piece_len for p in pieces) <= pieces[0].bin_len


def test_run_is_registered(spark, small, stages):
    import __spark_entry__ as entry

    assert sorted(entry.queries()["pipeline"](spark, small).collect()) == sorted(stages[4].collect())


def test_empty_documents_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, small), name)
    assert docs.count() == 0


def test_odd_documents(spark, small):
    rows = [(None, None, None, None, None), (None, "no id here", "en", "a", 10), (1, "", "en", "a", 0), (2, "same words here " * 9, None, None, 5), (2, "same words here " * 9, None, None, 5), (3, "same words here " * 9, "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, small), name)
    assert {r.doc_id for r in docs.collect()} <= {None, 2}


def test_texts_stay_where_nothing_is_labelled(spark):
    rows = [(1, "words here", None, "a", 10), (2, "123 !", None, "a", 5), (3, None, None, "a", 0), (4, "\n\u6f22", None, "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert set(by_id(cp.identify_language(spark, docs, ""))) == {1, 4}
