"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from terrella.llm import near_dup, substring
from terrella.llm.blocks import blocks, windows

from .fixtures import SCHEMA, documents, odd, words


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, shingles(t, k))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, sf, k, num):
    docs = documents(spark, sf)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k, num, 100)
    got = near_dup.near_duplicates(docs, k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_documents(spark):
    got = near_dup.near_duplicates(odd(spark), 3, 85, 100).collect()
    assert len(got) == 17
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 0 and by[1].component_id == 0 and not by[1].kept
    assert by[8].component_id == 7  # lower case
    assert [by[i].n_shingles for i in (3, 4, 5, 6, 7)] == [0, 0, 0, 1, 1]
    assert all(by[i].kept for i in (0, 3, 4, 5, 6, 7, 11))
    assert by[None].component_id is None and by[None].kept
    assert near_dup.near_duplicates(odd(spark).limit(0), 3, 85, 100).collect() == []


def test_dropping_near_duplicates_keeps_columns_and_one_of_each_group(spark):
    docs = odd(spark)
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(11) == 1 and ids.count(None) == 1 and 1 not in ids and 2 not in ids and 0 in ids


def test_different_texts_of_one_doc_id_stay_and_true_repeats_go(spark):
    text = lambda n: " ".join(f"{n}_{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("b")), (2, text("c")), (2, text("c")), (2, text("b") + " more"), (3, text("a") + " more"), (3, text("d")), (4, text("c") + " more")]
    left = near_dup.drop_near_duplicates(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert sorted(r.text[0] for r in left) == ["a", "b", "c", "d"]


def test_a_chain_of_near_copies_is_one_component(spark):
    """Ends of the chain are no near copies, and no bucket needs to hold both."""
    base = [f"t{i}" for i in range(400)]
    rows = []
    for n in range(40):
        w = list(base)
        for j in range(n):
            w[j * 10] = f"new{j}"
        rows.append((n, " ".join(w), None, None, None))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85, 100).collect()
    want = brute([(r[0], r[1]) for r in rows], 3, 85, 100)
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}


@pytest.mark.parametrize("seed", [11, 22, 24])
def test_near_copies_are_found_behind_shared_boilerplate_of_smaller_ids(spark, seed):
    """The last document shares a bucket with each of two smaller ids that are only partly alike; all buckets with its near copy hold just the two."""
    rng = np.random.default_rng(seed)
    a, b = ([f"{n}{seed}_{i}" for i in range(100)] for n in "ab")
    x = a + b + [f"x{seed}_{i}" for i in range(10)]
    copy = list(x)
    for j in range(4):
        copy[int(rng.integers(0, len(copy)))] = f"n{seed}_{j}"
    texts = [a + [f"p{seed}_{i}" for i in range(10)], b + [f"q{seed}_{i}" for i in range(10)], copy, x]
    rows = [(n, " ".join(w), None, None, None) for n, w in enumerate(texts)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 80, 100).collect()
    want = brute([(r[0], r[1]) for r in rows], 5, 80, 100)
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}
    assert want[3][1] == 2


def test_estimates_follow_similarity():
    h = near_dup.Hasher(near_dup.BANDS, 7)
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)])
        pa_, pb = (near_dup._planes([h.packed(h.minima(x))], 224) for x in (a, b))
        assert abs(near_dup.estimate(near_dup.agreeing(pa_, pb), 224)[0] - share) < 0.15


def test_components_of_long_paths(spark):
    links = spark.range(1, 200).selectExpr("id as a", "id - 1 as b").union(spark.range(300, 301).selectExpr("id as a", "301 as b"))
    got = {r.id: r.label for r in near_dup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 200)) and got[301] == 300


def test_word_hashes_do_not_depend_on_the_block():
    texts = ["a b c", None, "", " x  a\tb ", "ü a", "b"] * 3
    whole = [tuple(x) for b in blocks(pa.array(texts), lower=True) for h, at in [b.word_hashes()] for x in np.split(h, at[1:-1])]
    single = [tuple(b.word_hashes()[0]) for t in texts for b in blocks(pa.array([t], pa.string()), lower=True)]
    assert whole == single
    assert [len(x) for x in whole[:6]] == [3, 0, 0, 3, 2, 1]
    h, at = next(iter(blocks(pa.array(["a b c d", "c d e"])))).word_hashes()
    w, first = windows(h, at, 3)
    assert first.tolist() == [0, 1, 4]


def repeats_by_force(rows, n):
    """doc_ids that hold n words in a row of an earlier document, as whole words."""
    seen, out = {}, set()
    for d, t in sorted(rows):
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if seen.setdefault(k, d) != d:
                out.add(d)
    return out


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_repeats_equal_brute_force(spark, scale):
    docs = documents(spark, f"/root/testdata/sf{scale}")
    want = repeats_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)
    got = substring.repeats(docs, 50).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in got:
        assert r.owner_id < r.doc_id and r.n_words >= 50
        assert texts[r.doc_id][r.start : r.end] == texts[r.owner_id][r.owner_start : r.owner_start + r.end - r.start]
    # single spaces part words in these texts, or the same white space; so whole-word passages agree
    assert {r.doc_id for r in got} == want


def test_removal_leaves_first_places_and_clean_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    filler = lambda n: " ".join(f"f{n}_{i}" for i in range(40))
    rows = [(n, f"{filler(n)}\n{passage}\n{filler(n + 100)}", "en", "s", 5) for n in range(4)] + [(9, filler(7) + " clean", "en", "s", 5), (10, None, None, None, None), (None, passage, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert got[0].text == rows[0][1] and got[9].text == rows[4][1] and got[10].text is None and got[None].text == passage
    for n in (1, 2, 3):
        assert "p30 p31" not in got[n].text and filler(n) in got[n].text and filler(n + 100) in got[n].text
        assert got[n].n_chars == len(got[n].text)
    out = substring.remove_repeats(odd(spark))
    assert out.columns == odd(spark).columns and out.count() == 17


def test_a_passage_is_found_whose_parts_were_first_seen_in_other_documents(spark):
    """Halves of a passage in two documents, or in one at two distances; the whole passage only in later ones."""
    filler = lambda n: " ".join(f"f{n}_{i}" for i in range(40))
    rows = []
    for at, apart in ((0, True), (100, False)):
        one, two = (" ".join(f"{h}{at}_{i}" for i in range(30)) for h in "ab")
        early = [f"{filler(at)} {one} {filler(at + 1)}", f"{filler(at + 2)} {two}"] if apart else [f"{two} {filler(at)} {one}"]
        for n, text in enumerate([*early, f"{filler(at + 3)} {one} {two} {filler(at + 4)}", f"{one} {two} {filler(at + 5)}", f"{filler(at + 6)}\n{one} {two}"]):
            rows.append((at + n, text, "en", "s", 5))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.owner_id, r.n_words) for r in substring.repeats(docs, 50).collect()}
    assert got == {(3, 2, 60), (4, 2, 60), (102, 101, 60), (103, 101, 60)}
    left = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    assert all(f"{h}{at}_10" not in left[d] for at, ids in ((0, (3, 4)), (100, (102, 103))) for d in ids for h in "ab")


def test_removal_cuts_only_the_text_of_a_doc_id_that_has_the_passage(spark):
    passage, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "pq")
    rows = [(1, passage), (2, "head " + passage), (2, other)]
    left = substring.remove_repeats(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert sorted(r.text.strip() for r in left) == sorted([passage, "head", other])


def test_every_window_of_an_earlier_document_lies_in_a_repeat(spark):
    rng = np.random.default_rng(5)
    parts = [[f"{n}_{i}" for i in range(rng.integers(5, 40))] for n in range(12)]
    rows = [(d, " ".join(w for n in rng.integers(0, 12, 20) for w in parts[n]), None, None, None) for d in range(40)]
    rows.append((40, "long " * 3000 + "end", None, None, None))
    rows.append((41, "long " * 2000 + "end", None, None, None))
    spans = {}
    for r in substring.repeats(spark.createDataFrame(rows, SCHEMA), 50).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    seen, missed, found = {}, 0, 0
    for d, t, *_ in rows:
        at = [m.span() for m in re.finditer(r"\S+", t)]
        for i in range(len(at) - 49):
            s, e = at[i][0], at[i + 49][1]
            if seen.setdefault(t[s:e], d) != d:
                found += 1
                missed += not any(x <= s and e <= y for x, y in spans.get(d, []))
    assert found > 100 and missed == 0


def test_chunks_resist_insertions_and_every_passage_has_a_chunk_of_its_own():
    def found(t):
        b = next(iter(blocks(pa.array([t]))))
        s, e, first, last, _ = substring.chunks(b, substring.gear(b), 0, 50)
        assert ((last - first >= 11) & (last - first < 50) & (first > np.arange(len(first))) & (last < np.arange(len(first)) + 49)).all()
        return {t.encode()[s[x] : e[y]] for x, y in zip(first, last, strict=True)}

    text = " ".join(f"w{i * 7919 % 1009}" for i in range(600))
    a, b = found(text), found(text[:300] + "12 345" + text[300:])
    assert len(a - b) <= 8 and len(a & b) > 20
    rng = np.random.default_rng(8)
    for _ in range(200):  # one-letter words, and longer ones, amid different neighbours
        passage = " ".join("abcdefghij"[k] * int(rng.integers(1, 3)) for k in rng.integers(0, 10, 50))
        one, two = (" ".join("klmnopq"[k] for k in rng.integers(0, 7, 30)) for _ in "ab")
        both = found(f"{one} {passage} {two}") & found(f"{two}x {passage} {one}")
        assert any(c.decode() in passage for c in both)
