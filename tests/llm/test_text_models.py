"""Decontamination, packing, language ID, language model and token counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracklode.llm import decontaminate, langid, lm, packing, tokencounts

from .helpers import crc, documents, prose, rows, words

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination_by_hand(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = item_words(t), set(), set()
        for name, text in items:
            v = item_words(text)
            size = min(13, len(v))
            windows = {tuple(v[j : j + size]) for j in range(len(v) - size + 1)} if v else set()
            for j in range(len(w) - size + 1) if windows else ():
                if tuple(w[j : j + size]) in windows:
                    hit |= set(range(j, j + size))
                    found.add(str(name))
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_contamination(spark, limit):
    item = prose(1, 30)
    items = [(1, item), (2, "Tiny item"), (10, "tiny ITEM"), (3, None), (4, "..."), (5, prose(2, 13))]
    docs = [(1, prose(5, 50) + ", " + ". ".join(item.split()[4:19])), (2, "a Tiny-item here É"), (3, prose(6, 400) + " tiny item"), (4, None), (5, ""), (6, " ".join(item.split()[:12])), (7, item), (8, "ÉTiny item"), (9, "tiny item tiny item")]
    bench = spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, key string")
    got = decontaminate.contamination(documents(spark, docs), bench, broadcast_chars=limit)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()} == contamination_by_hand(docs, items)
    kept = decontaminate.decontaminate(documents(spark, docs), bench, broadcast_chars=limit)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in contamination_by_hand(docs, items).items() if not x[3]}
    assert kept.columns == documents(spark, docs).columns


@pytest.mark.parametrize("limit", [10**6, 0])
def test_contamination_of_null_ids_and_repeated_rows(spark, limit):
    item = prose(1, 20)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [(None, item), (None, "clean words"), (4, item), (4, item), (4, "other text"), (5, None), (5, None)])
    got = decontaminate.contamination(docs, bench, broadcast_chars=limit)
    want = [(4, 20, True), (4, 20, True), (4, 0, False), (5, 0, False), (5, 0, False), (None, 20, True), (None, 0, False)]
    assert rows(got, "doc_id", "n_hit", "contaminated") == sorted(want, key=repr)
    kept = decontaminate.decontaminate(docs, bench, broadcast_chars=limit)
    assert rows(kept, "doc_id", "text") == sorted([(None, "clean words"), (4, "other text"), (5, None), (5, None)], key=repr)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.contamination(documents(spark, [(1, "a b")]), none), "doc_id", "n_hit", "contaminated") == [(1, 0, False)]
    assert decontaminate.contamination(documents(spark, []), none).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = [(i, prose(i, 20 * i % 700 + 1)) for i in range(1, 60)] + [(100, prose(3, 6000)), (101, None), (102, ""), (103, "Été <|endoftext|> x y Σς"), (None, "a b"), (7, "repeat")]
    got = packing.pack(documents(spark, docs), path).toPandas()
    for seq, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["length"].sum() <= 4096 and (part["length"].cumsum() - part["length"]).tolist() == part["offset"].tolist()
    pieces = {(int(i) if i == i else None, int(s), int(n)): int(c) for i, s, n, c in got[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False)}
    for i, t in docs:
        if i == 7:
            continue
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((s, n) for d, s, n in pieces if d == i)
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == pieces[i, s, n] for s, n in own)
    assert len(got[got.doc_id == 7]) == 2
    assert packing.pack(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("lengths", [lambda r: r.integers(3, 12, 30_000), lambda r: 1 + r.exponential(700, 20_000), lambda r: r.integers(17, 21, 40_000), lambda r: 1 + r.exponential(60, 20_000)])
def test_packing_plan_uses_every_piece_with_little_padding(lengths):
    sizes = packing.bin_sizes(4096)
    pieces = np.minimum(4096, lengths(np.random.default_rng(2)).astype(int))
    at = np.searchsorted(sizes, pieces)
    assert (np.diff(sizes) <= np.maximum(1, sizes[:-1] / 128)).all() and sizes[-1] == 4096
    counts = np.bincount(at, minlength=len(sizes))
    used = np.zeros_like(counts)
    sequences = 0
    for pattern, times in packing.plan(counts, sizes, 4096):
        assert sum(sizes[b] * m for b, m in pattern.items()) <= 4096
        for b, m in pattern.items():
            used[b] += m * times
        sequences += times
    assert (used == counts).all() and pieces.sum() / 4096 > 0.99 * (sequences - 1)


def test_packing_of_short_and_of_long_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [(i, prose(i, 3 + i % 9)) for i in range(3000)] + [(5000, prose(1, 150_000))]
    got = packing.pack(documents(spark, docs), path).toPandas()
    tokens, sequences = got["length"].sum(), got["sequence_id"].nunique()
    assert tokens > 0.98 * 4096 * (sequences - 1) and got.groupby("sequence_id")["length"].sum().max() <= 4096
    assert got[got.doc_id == 5000]["length"].sum() == got[got.doc_id == 5000]["doc_tokens"].iloc[0]


def test_nnls_solves_a_known_problem():
    sizes = np.arange(1, 9)
    parts = packing.combinations(sizes, np.ones(8, bool), 8)
    assert {tuple(p) for p in parts.tolist()} >= {(7, -1, -1, 1), (3, 3, -1, 1), (2, 2, 1, 1)}

    def pieces(x):
        out = np.zeros(9)
        for (a, b, c, m), v in zip(parts, x, strict=True):
            np.add.at(out, [a, b, c], [m * v, v, v])
        return out[:8]

    want = np.zeros(len(parts))
    want[[3, 7]] = 5, 9
    x = packing.nnls(parts, pieces(want))
    assert (x >= 0).all() and np.allclose(pieces(x), pieces(want), atol=1e-6)


LANGS = {"aa": "the and of with that which this from", "bb": "der die und nicht mit auch ein werden", "cc": "это что как его она так было еще"}


def language_rows():
    import random

    rng = random.Random(4)
    return [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(sorted(LANGS) * 15)]


def test_language_id(spark):
    model = langid.train(documents(spark, language_rows()))
    mixed = LANGS["aa"] + " " + LANGS["aa"] + ". " + LANGS["cc"]
    tests = [(1, LANGS["aa"], None), (2, "DER DIE UND NICHT", None), (3, LANGS["cc"], None), (4, None, None), (5, "12 34 !?", None), (6, mixed, None), (7, "漢字かな", None), (8, "", None), (8, LANGS["bb"] * 500, None)]
    got = langid.identify(documents(spark, tests), model, spans=True).collect()
    assert [(r.doc_id, r.lang_pred) for r in got if r.doc_id != 7] == [(1, "aa"), (2, "bb"), (3, "cc"), (4, "und"), (5, "und"), (6, "aa"), (8, "und"), (8, "bb")]
    spans = next(r.spans for r in got if r.doc_id == 6)
    assert [s.lang for s in spans] == ["aa", "cc"] and mixed.encode()[spans[1].start : spans[1].end].decode() == LANGS["cc"]
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = langid.keep_identified(documents(spark, tests), model)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 6, 7, 8} and kept.columns == documents(spark, tests).columns


def test_language_id_without_training_rows(spark):
    model = langid.train(documents(spark, [(1, None, "aa"), (2, "x", None)]))
    assert rows(langid.identify(documents(spark, [(1, "abc"), (2, None)]), model), "doc_id", "lang_pred", "score") == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.identify(documents(spark, []), model).count() == 0


def test_language_id_of_long_texts_and_many_languages(spark):
    model = langid.train(documents(spark, language_rows()))
    data = (LANGS["bb"] + " " + LANGS["cc"] + ", ").encode() * 40
    byte = np.frombuffer(data, np.uint8)
    offs = np.array([0, len(byte)])
    whole = langid.word_scores(model, byte, offs)
    parts = [(langid.word_scores(model, part, own), at) for _, at, part, own in langid.pieces(byte, offs, 97)]
    assert len(parts) > 20 and np.allclose(np.concatenate([g[0] for g, _ in parts]), whole[0], atol=1e-3)
    assert np.concatenate([g[1] + at for g, at in parts]).tolist() == whole[1].tolist()
    han = np.frombuffer(("漢字" * 300).encode(), np.uint8)
    assert b"".join(p.tobytes() for _, _, p, _ in langid.pieces(han, np.array([0, len(han)]), 97)).decode() == "漢字" * 300
    scores = np.random.default_rng(3).normal(0, 1, (40, 300)).astype(np.float32)
    assert langid.viterbi(scores, np.array([0, 40]), 0.0).tolist() == scores.argmax(axis=1).tolist()
    text = LANGS["aa"] * 60_000
    got = langid.identify(documents(spark, [(1, text)]), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "aa")]


def test_viterbi_equals_exhaustive_search():
    import itertools

    rng = np.random.default_rng(0)
    scores, bounds, penalty = rng.normal(0, 2, (17, 3)).astype(np.float32), np.array([0, 6, 6, 7, 17 - 4, 17]), 1.5
    path = langid.viterbi(scores, bounds, penalty)
    value = lambda p, s: sum(s[i][x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p))
    for a, b in itertools.pairwise(bounds):
        best = max((value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(path[a:b], scores[a:b]) - best) < 1e-4


def lm_documents():
    return [(i, prose(i % 7, 30 + i % 50)) for i in range(120)] + [(500, None), (501, ""), (502, "Never SEEN words"), (3, "aw1 aw1")]


def test_lm_base_scores_and_counts(spark):
    from pyspark.sql import functions as F

    data = lm_documents()
    got = lm.score(documents(spark, data), F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()
    c = Counter()
    for i, t in data:
        if crc(i) % 5 != 1:
            c.update([*words(t), None])
    total, distinct = sum(c.values()), len(c)
    seen = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    want = sorted((i, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for i, w in ((i, [*words(t), None]) for i, t in data))
    assert seen == want
    held = [r for r in got if crc(r.doc_id) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_without_training_and_empty(spark):
    from pyspark.sql import functions as F

    got = lm.score(documents(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm.score(documents(spark, []), F.lit(True)).count() == 0


def plain_lm_score(v, model, text):
    """The score of a text word by word, with every probability normalised over all entries and checked to sum to 1."""
    words_, out, out_bias, classes, class_bias, weights = (x.astype(float) for x in model.parts(v))
    tokens = [*words(text), None]
    data = np.frombuffer((" ".join(w.decode() for w in words(text)) or " ").encode(), np.uint8)
    starts, ends, _ = lm_spans(data)
    hashes = textkit_hashes(data, starts, ends)
    ending = lm.endings(data, starts, ends) if len(starts) else np.zeros(0, np.uint8)
    entries = [*v.entries(hashes, ending).tolist(), v.end]
    counts = dict(zip(v.known.tolist(), v.known_count.tolist(), strict=True))
    total = 0.0
    for i, e in enumerate(entries):
        context = [entries[i - k] if i >= k else v.end for k in range(1, lm.CONTEXT + 1)]
        q = sum(words_[c] * weights[k] for k, c in enumerate(context))
        p_class = np.exp(q @ classes.T + class_bias)
        p_class /= p_class.sum()
        p = np.zeros(len(v.counts))
        for c in range(lm.CLASSES):
            own = np.flatnonzero(v.members == c)
            inside = np.exp(out[own] @ q + out_bias[own])
            p[own] = p_class[c] * inside / inside.sum()
        assert abs(p.sum() - 1) < 1e-6
        total += math.log10(p[e])
        if e >= v.own:
            total += math.log10(counts.get(int(hashes[i]), 0) + 0.5) - v.rest_log[ending[i]]
    assert len(tokens) == len(entries)
    return total


def textkit_hashes(data, starts, ends):
    from tracklode.llm import textkit

    return textkit.word_hashes(data, starts, ends).view(np.int64)


def lm_spans(data):
    from tracklode.llm import textkit

    return textkit.word_spans(data, np.array([0, len(data)]), textkit.space_table())


def test_lm_scores_match_a_plain_model(spark):
    from pyspark.sql import functions as F

    data = [(i, prose(i % 9, 40 + i % 30)) for i in range(80)] + [(500, None), (501, ""), (502, "Never SEEN words aw1"), (503, "aw1 AW1 bw2")]
    docs = documents(spark, data)
    texts = docs.where("doc_id <> 502").select(F.col("doc_id").alias("id"), "text")
    counted = texts.select("text").mapInArrow(lm.count_batches, "word long, ending int, n long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("c"))
    v = lm.vocabulary(counted)
    assert v.own > 50 and np.allclose(v.counts.sum(), v.tokens)
    model = lm.train(spark, texts, v)
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") != 502).collect()}
    for i, t in data[::11] + data[-4:]:
        assert got[i] == pytest.approx(plain_lm_score(v, model, t), rel=2e-3)


def test_lm_learns_more_than_counts_whatever_the_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    import random

    rng = random.Random(2)
    follow = [[rng.randrange(150) for _ in range(3)] for _ in range(150)]
    data = []
    for i in range(300):
        chain = [rng.randrange(150)]
        while len(chain) < 200:
            chain.append(rng.choice(follow[chain[-1]]))
        data.append((i, " ".join(f"w{k}" for k in chain)))
    # Scores follow from the rows, not from their partitions; with several shards too. A word has three followers of 150.
    for shard_tokens, least in ((lm.SHARD_TOKENS, 0.5), (15_000, 0.3)):
        monkeypatch.setattr(lm.train, "__defaults__", (shard_tokens,))
        found = []
        for parts in (1, 4, 32):
            rows_ = documents(spark, rng.sample(data, len(data))).repartition(parts)
            found.append({r.doc_id: r for r in lm.score(rows_, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()})
            held = [r for r in found[-1].values() if crc(r.doc_id) % 5 == 1]
            assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held) > least
        for other in found[1:]:
            assert all(other[i].score == pytest.approx(r.score, rel=1e-6) for i, r in found[0].items())


def test_edited_counts(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = [(i, prose(i, 40 * i) + f" mail a{i}@b.org or +1 555 123 45{i}0. " + prose(i + 50, 30)) for i in range(12)] + [(50, None), (51, ""), (52, "a@b.cd"), (53, "x" * 3000 + " a@b.cd"), (None, "   spaces\n\n here  "), (1, "again")]
    got = tokencounts.edited_counts(documents(spark, data), path, public_tokenizers.PATTERN).collect()

    def edited(text):
        for a, b, new in reversed(tokencounts.redactions(text)):
            text = text[:a] + new + text[b:]
        return text

    want = sorted(((i, len(enc.encode_ordinary(t or "")), len(enc.encode_ordinary(edited(t or "")))) for i, t in data), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got), key=repr) == want
    assert all(r.n_encoded_again <= 3 * r.n_edits for r in got)
    assert tokencounts.edited_counts(documents(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_segment_tree_random_edits():
    import random

    rng = random.Random(8)
    count = tokencounts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count
    for seed in range(40):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "12", "é", "'s", ".", "word "]) for _ in range(300))
        tree = tokencounts.SegmentTree(text, count, 16)
        assert tree.total == count(text)
        for _ in range(4):  # each time on the text that the edits before left
            cuts = sorted(rng.sample(range(len(text) + 1), 12))
            edits = [(a, b, rng.choice(["", " ", "new", "x y", "\n\n", "longer words here"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            for a, b, r in reversed(edits):
                text = text[:a] + r + text[b:]
            tree.apply(edits)
            assert tree.text == text and tree.total == count(text)
