"""Line dedup, MinHash near-dedup and suffix-array dedup against brute force."""

import itertools
import random

import numpy as np
import pytest

from tracklode.llm import linededup, minhash, suffixdedup, textkit
from tracklode.llm.common import connected_components

from .helpers import documents, prose, rows, words


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked_components(sets, hundred, per):
    comp = {i: i for i in sets}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and hundred * len(sets[a] & sets[b]) >= per * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def near_copies():
    rng = random.Random(5)
    base = prose(1, 300).split()
    out = [(1, " ".join(base))]
    for i in range(2, 40):  # near copies that often miss the threshold with each other
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    out += [(50 + i, prose(100 + i, 40)) for i in range(10)]
    return [*out, (70, out[4][1].upper()), (71, out[4][1]), (72, "one two"), (73, "ONE  two\n"), (74, None), (75, ""), (76, " \t\n"), (77, "é É"), (None, out[0][1])]


def test_minhash_matches_brute_force(spark):
    data = near_copies()
    want = linked_components({i: shingles(t, 3) for i, t in data if i is not None}, 100, 85)
    got = minhash.near_duplicates(documents(spark, data), k=3, per=85)
    for r in got.collect():
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(shingles(dict(data)[r.doc_id], 3)))


def test_minhash_empty_and_repeated_rows(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    got = minhash.near_duplicates(documents(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f")]))
    assert rows(got, "doc_id", "component_id", "kept") == [(3, 3, True), (5, 3, False), (5, 3, False)]


def test_minhash_of_ids_with_several_texts(spark):
    a, b = prose(1, 80), prose(2, 80)
    data = [(5, a), (5, b), (9, b), (8, a + " tail"), (5, a), (5, b + " tail"), (7, prose(3, 50))]
    got = minhash.near_duplicates(documents(spark, data))
    assert rows(got, "doc_id", "component_id", "kept") == sorted([(i, 7 if i == 7 else 5, i in (5, 7)) for i, _ in data], key=repr)
    kept = minhash.keep_first(documents(spark, data))
    texts = rows(kept, "doc_id", "text")
    assert [t for t in texts if t != (5, b) and t != (5, b + " tail")] == sorted([(5, a), (5, a), data[6]], key=repr) and len(texts) == 4


def test_keep_first_keeps_columns(spark):
    docs = documents(spark, near_copies())
    got = minhash.keep_first(docs, k=3, per=85)
    assert got.columns == docs.columns
    assert {72, 74, 75, 76, None} <= {r.doc_id for r in got.collect()} and 73 not in {r.doc_id for r in got.collect()}


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    a, b = pool[:2000], pool[500:2500]
    same = (minhash.signature(a, 256) == minhash.signature(b, 256)).mean()
    assert abs(same - 1500 / 2500) < 0.12
    # Coordinate k is the minimum under the second permutation shifted by k.
    first, shifted = minhash.permutations(256)
    at = first[(a >> np.uint64(44)).astype(np.int64)]
    second = shifted[:, 0]
    assert all(minhash.signature(a, 256)[k] == second[(at + k) % len(second)].min() for k in (0, 1, 255))


def test_word_hashes_agree_with_plain_splitting():
    import pyarrow as pa

    texts = ["Ab  cd\nAB\x0bçd", "", None, "x" * 5000 + " y", " nbsp stays"]
    seen = {}
    for lo, hi, data, offs in textkit.text_chunks(pa.array(texts), 100):
        starts, ends, row = textkit.word_spans(data, offs, textkit.space_table())
        for h, r in zip(textkit.word_hashes(data, starts, ends).tolist(), row, strict=True):
            seen.setdefault(lo + r, []).append(h)
    plain = [words(t) for t in texts]
    assert [len(seen.get(i, [])) for i in range(5)] == [len(w) for w in plain]
    by_word = {}
    for i, w in enumerate(plain):
        for x, h in zip(w, seen.get(i, []), strict=True):
            assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_are_hashed_in_blocks():
    rng = random.Random(1)
    for t in range(60):
        text = "".join(rng.choice(["a", "B", "é", " ", "\n", "xyz"]) for _ in range(rng.randrange(200)))
        text = text.replace(" ", "q").replace("\n", "r") if t % 3 == 0 else text
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = textkit.word_spans(data, np.array([0, len(data)]), textkit.space_table())
        for got, want in zip(textkit.long_words(data, textkit.space_table(), True, 7), (starts, ends, textkit.word_hashes(data, starts, ends)), strict=True):
            assert (got == want).all()


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(7, 7), (None, 3)] + [(1000, i) for i in range(300, 380)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    want = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a in want and b in want and a is not None and a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def line_cases():
    long_ = "this one line is long enough to count as a passage by itself, at well over eighty characters"
    run = ["alpha line", "beta line", "gamma line"]
    return [
        (1, "\n".join(["head one", *run, "tail one"])), (2, "\n".join(["head two", *run, "", "tail two"])), (3, "\n".join(run[1:])), (4, "alpha line\nsolo"), (5, long_), (6, f"before\n{long_}\nafter"),
        (7, "same\nsame\nsame"), (8, None), (9, ""), (10, "\n \n"), (None, "\n".join(run)), (11, "\n".join(["head one", *run, "tail one"])),
    ]


def plain_line_dedup(data, min_lines=2, min_chars=80):
    """Deleted line places by id: windows of min_lines, or one long line, seen before in id order."""
    seen, gone = set(), {i: set() for i, _ in data}
    for i, t in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        lines = [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        for size, ok in ((min_lines, lambda w: True), (1, lambda w: len(w[0][1]) >= min_chars)):
            for j in range(len(lines) - size + 1):
                w = lines[j : j + size]
                name = (size, tuple(x for _, x in w))
                if name in seen and ok(w):
                    gone[i] |= {k for k, _ in w}
                seen.add(name)
    return gone


def test_line_dedup_matches_brute_force(spark):
    data = line_cases()
    docs = documents(spark, data)
    got = {r.doc_id: r for r in linededup.dedup_lines(docs, with_runs=True).collect()}
    want = plain_line_dedup(data)
    for i, t in data:
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in want[i]]
        text = t if not want[i] else ("" if not "".join(left).strip() else "\n".join(left))
        assert (got[i].text, got[i]._tl_deleted) == (text, len(want[i]))
    assert [got[i]._tl_longest for i in (1, 2, 3, 4, 7, 8, 11)] == [5, 3, 2, 1, 2, 0, 5]
    assert linededup.dedup_lines(docs).drop("_tl_deleted").columns == docs.columns


def test_line_dedup_random_and_empty(spark):
    assert linededup.dedup_lines(documents(spark, []), with_runs=True).count() == 0
    rng = random.Random(9)
    data = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    want = plain_line_dedup(data)
    got = {r.doc_id: r._tl_deleted for r in linededup.dedup_lines(documents(spark, data)).collect()}
    assert got == {i: len(want[i]) for i in got}


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup_runs_of_any_length(spark, min_lines):
    rng = random.Random(min_lines)
    stock = [[f"line {k} {j}" for j in range(7)] for k in range(6)]
    data = []
    for i in range(50):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            part = rng.choice(stock)
            lines += part[rng.randrange(3) : rng.randrange(4, 8)] + [f"own {i}"] * rng.randrange(2)
        data.append((i, "\n".join(lines)))
    want = plain_line_dedup(data, min_lines)
    got = {r.doc_id: r for r in linededup.dedup_lines(documents(spark, data), min_lines=min_lines, with_runs=True).collect()}
    short = {r.doc_id: r._tl_deleted for r in linededup.dedup_lines(documents(spark, data), min_lines=min_lines).collect()}
    assert {i: r._tl_deleted for i, r in got.items()} == {i: len(want[i]) for i in got} == short
    lines = {i: t.split("\n") for i, t in data}

    def longest(i):
        places = [(j, a) for j in lines for a in range(len(lines[j]))]
        best = 0
        for a in range(len(lines[i])):
            for j, b in places:
                if (j, b) != (i, a):
                    n = 0
                    while a + n < len(lines[i]) and b + n < len(lines[j]) and lines[i][a + n] == lines[j][b + n]:
                        n += 1
                    best = max(best, n)
        return best

    assert all(got[i]._tl_longest == longest(i) for i in list(got)[::7])


def test_repeated_passages(spark):
    passage = prose(77, 60)
    whole = prose(78, 90)
    data = [(1, prose(1, 200) + " " + passage + " " + prose(2, 30)), (2, passage.upper()), (3, prose(3, 5) + " " + passage), (4, whole), (5, whole), (6, prose(6, 500)), (7, None), (8, ""), (9, "short"), (None, passage), (10, " ".join(passage.split()[:45]) + " " + prose(10, 80))]
    got = suffixdedup.repeated_passages(documents(spark, data))
    text = dict(data)
    for r in got.collect():
        own, other = words(text[r.doc_id]), words(text[r.other_doc_id])
        assert r.n_words >= 50 and own[r.start : r.start + r.n_words] == other[r.other_start : r.other_start + r.n_words]
    assert {(r.doc_id, r.n_words) for r in got.collect()} == {(2, 60), (3, 60), (5, 90)}
    assert suffixdedup.repeated_passages(documents(spark, [])).count() == 0


def test_repeated_passages_under_common_grams(spark):
    # Many documents share notices of 30 words; two of them also share the 30 words in front, and go on differently.
    data, i = [], 100
    for k in range(8):
        notice, lead = prose(5000 + k, 30, 10**6), prose(6000 + k, 30, 10**6)
        for j in range(40):
            front = lead if j in (13, 31) else prose(7000 + 100 * k + j, 30, 10**6)
            data.append((i, f"{front} {notice} {prose(9000 + 100 * k + j, 60, 10**6)}"))
            i += 1
    # A middle of 40 words: one document shares it with what stands before, another with what stands behind.
    a, m, b = prose(1, 30, 10**6), prose(2, 40, 10**6), prose(3, 30, 10**6)
    data += [(1, f"{a} {m} {prose(4, 60, 10**6)}"), (2, f"{prose(5, 60, 10**6)} {m} {b}"), (3, f"{a} {m} {b}")]
    got = rows(suffixdedup.repeated_passages(documents(spark, data)), "doc_id", "start", "n_words", "other_doc_id", "other_start")
    want = [(100 + 40 * k + 31, 0, 60, 100 + 40 * k + 13, 0) for k in range(8)] + [(3, 0, 70, 1, 0), (3, 30, 70, 2, 60)]
    assert got == sorted(want, key=repr)


def common_runs(a, b, least):
    """Maximal common word runs of at least `least` words: (start in a, length, start in b)."""
    out = []
    for d in range(-len(b) + 1, len(a)):
        run = 0
        for i in range(max(0, d), min(len(a), len(b) + d) + 1):
            if i < min(len(a), len(b) + d) and a[i] == b[i - d]:
                run += 1
            else:
                if run >= least:
                    out.append((i - run, run, i - run - d))
                run = 0
    return out


@pytest.mark.parametrize("copies", [2, 3, 12, 40])
def test_repeated_passages_among_decoys(spark, copies):
    # Decoys share only the last 12 words of the passage; some ids have several texts.
    passage = prose(1, 55, 10**6)
    data = [(i, f"{prose(10 + i, i % 40, 10**6)} {passage} {prose(500 + i, 20, 10**6)}") for i in range(copies)]
    data += [(1000 + i, f"{prose(2000 + i, 40, 10**6)} {' '.join(passage.split()[-12:])} {prose(3000 + i, 40, 10**6)}") for i in range(60)]
    data += [(copies + 1, prose(77, 70, 10**6)), (copies + 1, f"{passage} x"), (copies + 1, f"{passage} x")]
    got = suffixdedup.repeated_passages(documents(spark, data))
    want = {(j, a, n, i, b) for (i, s), (j, t) in itertools.permutations(set(data), 2) if i < j and i < 1000 and j < 1000 for a, n, b in common_runs(words(t), words(s), 50)}
    found = {tuple(r) for r in got.select("doc_id", "start", "n_words", "other_doc_id", "other_start").collect()}
    assert found <= want and {x[0] for x in found} == {x[0] for x in want} == {*range(1, copies), copies + 1}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8])
def test_neighbours_of_few_suffixes(n):
    import pyarrow as pa

    side = np.arange(1, 41, dtype=">u4").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([5] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([9] * n, pa.int64()), pa.array([side] * n, pa.binary()), pa.array([side] * n, pa.binary())], ["id", "tk", "pos", "gram", "after", "before"])
    out = pa.Table.from_batches(list(suffixdedup.neighbour_batches(iter([batch]), 40, 50))).to_pylist()
    assert sorted(r["id"] for r in out if not r["edge"]) == list(range(1, n))


def test_line_dedup_of_a_text_of_many_lines(spark):
    long = "\n".join(f"line {i % 15_000}" if i % 3 else "" for i in range(60_000))
    text = {1: long, 2: "x\n" + long + "\nx", 3: "line 1\nonly here"}
    got = {r.doc_id: r for r in linededup.dedup_lines(documents(spark, text.items()), with_runs=True).collect()}
    # By a loop over pairs of neighbouring lines, blank ones left out.
    seen = set()
    for i in sorted(text):
        lines = text[i].split("\n")
        own = [k for k, line in enumerate(lines) if line.strip()]
        gone = set()
        for a, b in zip(own, own[1:]):
            pair = lines[a], lines[b]
            gone |= {a, b} if pair in seen else set()
            seen.add(pair)
        rest = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        assert got[i]._tl_deleted == len(gone) and got[i].text == (rest if rest.replace("\n", " ").strip() or not gone else "")
