"""The queries against SQL, brute force or held-out labels, over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from compare import same

from stepframe.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    return {r.doc_id: r for r in sorted(rows)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small), duck.sql(ORACLE[name]))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_components(rows, n, percent):
    """Ids and texts to (set size, least reachable id), by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_equals_all_pairs(spark, small, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_ngram_jaccard"](spark, small).collect()}
    assert got == brute_components([(i, r.text) for i, r in docs.items()], 4, 85)


def test_mixing_comes_near_its_targets(spark, small, docs):
    rows = QUERIES["op10_pareto_mixing"](spark, small).collect()
    again = QUERIES["op10_pareto_mixing"](spark, small).collect()
    assert sorted(rows) == sorted(again) and len(rows) == len(docs)
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    sources = sorted({r.source for r in docs.values()})
    total = {s: sum(size[i] for i, r in docs.items() if r.source == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    target, left, free = {}, float(sum(total.values())), set(sources)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        for s in over or free:
            target[s] = 3.0 * total[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == total[source] and r.target == pytest.approx(target[source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, r in docs.items() if r.source == s) / 2


def test_language_id_on_held_out_documents(spark, small, docs):
    rows = QUERIES["op7_language_id"](spark, small).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_on_held_out_documents(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = QUERIES["op5_bradley_terry_quality"](spark, small).collect()
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_lz_fingerprints_equal_single_ones(spark, small, docs):
    from stepframe.llm.fingerprints import fingerprints, likeness, to_hex

    rows = sorted(QUERIES["op8_lz_fingerprints"](spark, small).collect())
    ids = list(docs)
    for k, r in enumerate(rows):
        text, following = docs[ids[k]].text, docs[ids[(k + 1) % len(ids)]].text
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = fingerprints([text, edited, following])
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (ids[k], len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (to_hex(a), to_hex(b))
        assert (r.near_edited, r.near_next) == pytest.approx((likeness(a, b), likeness(a, c)))
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.98 * len(rows)


def test_packing_keeps_every_word(spark, small, docs):
    rows = QUERIES["op1_best_fit_packing"](spark, small).collect()
    spans, bins = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.piece_start, r.piece_len))
        if r.piece_len:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.piece_len, r.bin_len))
    for i, d in docs.items():
        own, at = sorted(spans[i]), 0
        for start, length in own:
            assert start == at
            at += length
        assert at == len(WORD.findall(d.text or ""))
    for pieces in bins.values():
        at = 0
        for offset, length, size in sorted(pieces):
            assert offset == at and size in (512, 1024, 2048, 4096)
            at += length
        assert at <= size and (size == 512 or at > size // 2)  # no shorter length would do


def test_lm_scores_follow_the_corpus(spark, small, docs):
    rows = {r.doc_id: r for r in QUERIES["op4_lm_scoring"](spark, small).collect()}
    for i, d in docs.items():
        assert rows[i].n_tokens == len(WORD.findall(d.text or "")) and rows[i].log_prob <= 0
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [i for i, q in label.items() if q == 1 and rows[i].n_tokens]
    symbols = [i for i, d in docs.items() if d.text.count("###") > 5]
    assert clean and symbols
    mean = lambda ids: sum(rows[i].log_prob for i in ids) / sum(rows[i].n_tokens for i in ids)
    share = Counter(w for d in docs.values() for w in WORD.findall(lower(d.text or "")))
    n = sum(share.values())
    unigram = sum(k * math.log(k / n) for k in share.values()) / n
    assert mean(rows) > unigram and mean(symbols) < mean(clean)
    again = {r.doc_id: r.log_prob for r in QUERIES["op4_lm_scoring"](spark, small).collect()}
    assert again == {i: r.log_prob for i, r in rows.items()}


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
