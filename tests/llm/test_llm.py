"""Operators of the llm folder against brute force, libraries, SQL and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lattica.llm import blocks as B
from lattica.llm import components as CC
from lattica.llm import decontamination, licenses, near_dedup, nearest, packing, quality, registry, substring_dedup, suffix_tree, textops, token_counts, toxicity

from ..conftest import SF, comparable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, block int, keys string"


def odd_rows(seed=0):
    """Nulls, empty and very long texts, repeated rows, copies, runs of one word, shared passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "naïve", "the", "a"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = text(40), text(120)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, shared), (None, None), (6, "same " * 50), (7, "other " + "same " * 30 + "end"), (8, text(4000) + " " + shared)]
    for i in range(9, 30):
        rows.append((i, text(rng.randrange(1, 60)) + (("\n" + shared + " ") if i % 3 == 0 else "") + text(rng.randrange(0, 30))))
    near = base.split()
    near[50] = "changed"
    rows.append((30, " ".join(near)))
    return [(i, t, "en", 7, "x") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracles(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    r = duck.execute(registry.ORACLE[name])
    assert comparable(df.columns, df.collect()) == comparable([d[0] for d in r.description], r.fetchall())


# 1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_token_counts(spark, odd, empty, library):
    got = rows_of(token_counts.token_counts(odd, P.path("word_bpe_49k.json"), limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in odd_rows()}
    assert got == sorted(((i, len((t or "").encode()), n[t], n[t] > 50) for i, t, *_ in odd_rows()), key=repr)
    assert token_counts.token_counts(empty, P.path("word_bpe_49k.json")).count() == 0


def test_transducer_equals_library_on_odd_texts(library):
    own = token_counts.Counter(P.path("word_bpe_49k.json"))
    rng = random.Random(5)
    parts = ["a", "the", "I", "'s", "'ll", "'r", "'", "!", " ", "\n", "12", "é", "É", "ß", "ΑΣ", "İ", "中", "😀", "​", "\x1c", "\x85", "½", "<|endoftext|>", "<|", "ing", "zz", "̀", "ﬁ", "한", "ᄒ", "ᅡ", "٣", "\x00", "हि"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_chunk_maps_compose(library, monkeypatch):
    own = token_counts.Counter(P.path("word_bpe_49k.json"))
    texts = [t or "" for _, t, *_ in odd_rows()]
    whole = [own.count(t) for t in texts]
    for size in (3, 17):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert [own.count(t) for t in texts] == whole


def test_chunk_maps_are_maps_of_states(library, monkeypatch):
    """Chunks of odd texts, cut anywhere, in any grouping; texts without a resetting character too."""
    own, rng = token_counts.Counter(P.path("word_bpe_49k.json")), random.Random(6)
    parts = ["a", "the", "'s", "'ll", "'r", "'re", "'v", "'", "''", "!", "!'", " ", "\n", "1", "é", "ß", "中", "😀", "\x85", "½", "ing", "zz", "token", "\u0301", "\u3000"]
    for turn in range(1500):
        t = own.normalise("".join(rng.choice(parts if turn % 3 else [p for p in parts if not p.isspace() and p not in "1½"]) for _ in range(rng.randrange(1, 14))))
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t), rng.randrange(4))))
        maps = [([], 0, own.walk.start), *(own.chunk_map(t[a:b]) for a, b in zip([0, *cuts], [*cuts, len(t)]))]
        while len(maps) > 1:  # associative: any two neighbours may be joined first
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [own.compose(*maps[i : i + 2])]
        assert maps[0][1] + own.walk.close(maps[0][2]) == len(library.encode(t, add_special_tokens=False).ids), t
    monkeypatch.setattr(token_counts, "CHUNK", 5)
    long = "".join(rng.choice("abcdefghij") for _ in range(3000))
    for t in (long, long + "!" + long, "'" * 500, "x 1" * 300, "中" * 200, "don't" * 300):
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_a_text_over_the_chunk_size(library):
    own, rng = token_counts.Counter(P.path("word_bpe_49k.json")), random.Random(7)
    t = " ".join("".join(rng.choice("etaoin shrdlu'") for _ in range(rng.randrange(1, 9))) for _ in range(40_000))
    assert len(t) > 2 * token_counts.CHUNK and own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


# 2


def test_language_model_base_columns(spark, odd, empty):
    got = suffix_tree.scores(odd).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    words = [(i, [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in WORD.findall(t or "")] + [None]) for i, t, *_ in odd_rows()]
    c = Counter(w for i, ws in words if i is not None and fold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, i is not None and fold(i) == 0, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in words), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert suffix_tree.scores(empty).count() == 0


def test_language_model_probabilities_sum_to_one():
    rng = random.Random(3)
    tree = suffix_tree.Tree(np.arange(1, 6, dtype=np.uint64), np.array([500, 400, 300, 200, 100]), 2000, 9)
    tree.codes = [np.array([0, 1, 7, 13]), np.array([0 * 5 + 2, 1 * 5 + 3])]
    tree.counts += [np.array([300, 150, 350, 290]), np.array([250, 120])]
    tree.build()
    assert any(k.any() for k in tree.retained)
    for context in ([1], [1, 1], [2, 3], [1, 2, 3], [9]):
        total = 0.0
        for w, count in [*zip(range(1, 6), tree.counts[0]), *[(50 + i, 500 / 4) for i in range(4)], (99, 0)]:
            tokens = np.array([*context, w], np.uint64)
            counts = np.array([0] * len(context) + [count])
            total += 10 ** tree.log10(suffix_tree._index(tree.words, tokens), np.array([0, len(tokens)]), counts)[1][-1]
        assert abs(total - 1) < 1e-9, context
    assert rng


def test_language_model_keeps_rare_contexts_of_large_corpora(spark):
    ids = iter(range(10_000))
    held = lambda i: zlib.crc32(str(i).encode()) % suffix_tree.FOLDS == 0
    train = [i for i in itertools.islice(ids, 60) if not held(i)]
    asked = next(i for i in ids if held(i))
    rows = [(i, "x " * 200_000) for i in train[:45]] + [(i, "rare pair") for i in train[45:49]] + [(asked, "rare pair")]
    r = suffix_tree.scores(spark.createDataFrame(rows, "doc_id long, text string")).where(f"doc_id = {asked}").first()
    assert r["train_tokens"] > 9_000_000
    assert r["n_in_context"] == 2 and r["score"] > r["base_score"] / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_language_model_is_the_tree_of_all_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("aabcdefgh") if rng.random() < 0.5 else "p q r s t" for _ in range(rng.randrange(30)))) for i in range(300)]
    held = lambda i: zlib.crc32(str(i).encode()) % suffix_tree.FOLDS == 0
    tokens = {i: [*t.split(), "END"] for i, t in rows}
    grams = [Counter(tuple(t[j : j + k]) for i, t in tokens.items() if not held(i) for j in range(len(t) - k + 1)) for k in (1, 2, 3, 4)]
    n = sum(grams[0].values())
    names = sorted(w for (w,), c in grams[0].items() if c >= 4)
    tree = suffix_tree.Tree(np.arange(len(names), dtype=np.uint64), np.array([grams[0][w,] for w in names]), n, len(grams[0]))
    place = {(w,): k for k, w in enumerate(names)}
    for g in grams[1:]:
        found = sorted((place[x[:-1]] * len(names) + place[x[-1:]], x) for x, c in g.items() if c >= 4)
        tree.codes.append(np.array([c for c, _ in found], np.int64))
        tree.counts.append(np.array([g[x] for _, x in found], np.int64))
        place |= {x: k for k, (_, x) in enumerate(found)}
    tree.build()
    got = {r["doc_id"]: r for r in suffix_tree.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in tokens.items():
        index = np.array([place.get((w,), -1) for w in t])
        _, model, used = tree.log10(index, np.array([0, len(t)]), np.array([grams[0][w,] for w in t]))
        assert got[i]["score"] == pytest.approx(model.sum()) and got[i]["n_in_context"] == used.sum()
    assert sum(r["n_in_context"] for r in got.values()) > 1000


def test_language_model_beats_base_on_held_out_rows(spark):
    r = suffix_tree.op2_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


# 3


def check_pieces(got, ids):
    """Each row's ids in exactly one piece, sequences gapless from 0 and no longer than allowed."""
    end = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end[r.sequence_id]
        end[r.sequence_id] += r.length
    assert max(end.values(), default=0) <= packing.LENGTH
    spans = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    for (doc, start, length, crc, total), _ in spans.items():
        assert any(total == len(x) and zlib.crc32(x[start : start + length].tobytes()) == crc for x in ids[doc])
    for doc, texts in ids.items():
        assert sum(r.length for r in got if r.doc_id == doc) == sum(map(len, texts))
    return end


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {}
    for i, t, *_ in odd_rows():
        ids.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    check_pieces(packing.pack(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect(), ids)
    assert packing.pack(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("<|endoftext|>", 50256))
    rng = random.Random(4)
    parts = ["a", "the", "'s", "'", "!", " ", "  ", "\n", "\t", "12", "é", "中", "😀", "​", "\x1c", "\x85", "½", "<|endoftext|>", "ing", "한", "\x00", "　"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(16)))
        assert own.encode(t, allowed_special="all") == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("kind", ["uniform", "third", "one", "few"])
def test_packing_pads_little(kind):
    rng = np.random.default_rng(1)
    r = rng.integers(1, 2048, 20 if kind == "few" else 20_000)
    if kind == "third":
        r[: len(r) // 3] = 1500
    if kind == "one":
        r[:] = 1100
    plan = packing.Plan(np.bincount(r // 64, minlength=32), np.bincount(r % 64, minlength=64))
    assert plan.sequences <= -(-r.sum() // 2048) * (1.002 if kind != "few" else 1) + 3


# 4


def removed_by_brute_force(rows, window=13):
    low = {}
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    key = lambda i: math.inf if i is None else i
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            low[g] = min(low.get(g, math.inf), key(i))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if low[tuple(w[k : k + window])] < key(i) for j in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [13, 5, 30])
def test_substring_dedup(spark, window):
    rows = odd_rows(window)
    got = substring_dedup.digests(spark.createDataFrame(rows, DOCS), window)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed_by_brute_force(rows, window)


def clashing_rows():
    """Ids that stand on rows with different texts, among copies and near copies."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"c{rng.randrange(500)}" for _ in range(n))
    a, b, c = text(40), text(40), text(30)
    return [(i, t, "en", 7, "x") for i, t in [(1, a), (2, a), (2, b), (3, "x " + b), (3, "x " + b), (4, c), (4, None), (4, ""), (5, c + " y"), (6, b), (None, c), (7, a + " z"), (7, text(20))]]


def test_substring_dedup_of_ids_with_several_texts(spark):
    rows = clashing_rows()
    got = substring_dedup.digests(spark.createDataFrame(rows, DOCS))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed_by_brute_force(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_of_long_passages(spark, seed):
    """Rows cut from a few long passages, so that long symbols settle much, among rows of their own."""
    rng = random.Random(seed)
    text = lambda n: [f"p{rng.randrange(3000)}" for _ in range(n)]
    passages, rows = [text(rng.randrange(60, 300)) for _ in range(10)], []
    for i in range(70):
        w = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 20)
            w += text(rng.randrange(8)) + p[a : a + rng.randrange(5, len(p))]
        rows.append((rng.choice([i, i, i, None, i // 2]), " ".join(w), "en", 7, "x"))
    got = substring_dedup.digests(spark.createDataFrame(rows, DOCS))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed_by_brute_force(rows)


def test_long_symbols_settle_most_of_a_long_passage():
    rng = np.random.default_rng(3)
    u = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    passage = u(600)
    docs = [np.concatenate((u(int(rng.integers(0, 50))), passage, u(30))) for _ in range(2)]
    first = np.cumsum([0, *map(len, docs)])
    symbols = substring_dedup.long_symbols(np.concatenate(docs), textops.mix(np.concatenate(docs)), first, 13)
    keys, check = symbols[0], symbols[1]
    mine = symbols[4] == 0
    order = np.lexsort((check[mine], keys[mine]))
    long = keys[mine][order], check[mine][order], np.zeros(mine.sum(), np.int64)
    done = substring_dedup.settled(symbols, np.array([0, 9]), long, 13, first[-1])
    assert not done[: first[1]].any() and 0.3 * 600 < done[first[1] :].sum() <= 600 - 12
    # The same of the second document alone: nothing depends on where it lies in a piece.
    alone = substring_dedup.long_symbols(docs[1], textops.mix(docs[1]), np.array([0, len(docs[1])]), 13)
    assert (substring_dedup.settled(alone, np.array([9]), long, 13, len(docs[1])) == done[first[1] :]).all()


def test_equal_keys_are_told_apart_by_check_bits():
    u = lambda *x: np.array(x, np.uint64)
    w = lambda *x: np.array(x, np.uint32)
    hit, at = substring_dedup._checked(u(3, 5, 5, 5, 9), w(1, 2, 4, 6, 7), u(5, 5, 5, 5, 3, 9, 8), w(6, 2, 5, 9, 1, 8, 7))
    assert hit.tolist() == [True, True, False, False, True, False, False] and at[:2].tolist() == [3, 1] and at[4] == 0
    assert not substring_dedup._checked(u(), w(), u(1), w(1))[0].any()


def test_without_repeats(spark, odd, empty):
    assert substring_dedup.digests(empty).count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0
    got = substring_dedup.without_repeats(odd)
    assert got.columns == odd.columns
    want = Counter((i, sha) for i, n, k, sha in removed_by_brute_force(odd_rows()) if not n or n > k)
    assert Counter((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in got.collect()) == want
    assert got.where("text is null").count() == odd.where("text is null").count()


def test_equal_substrings_share_interior_symbols():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, 400).astype(np.uint64)
    a, b = np.concatenate((rng.integers(0, 5, 37).astype(np.uint64), x)), np.concatenate((rng.integers(0, 5, 91).astype(np.uint64), x))
    for rounds in (1, 2, 3, 4):
        inner = []
        for t in (a, b):
            names, lo, hi = substring_dedup.recompress(textops.mix(t), np.zeros(len(t), np.int64), rounds)
            shift = len(t) - len(x)
            inside = (lo >= shift) & (hi < len(t))
            inner.append(sorted(zip(names[inside].tolist(), (lo[inside] - shift).tolist())))
        assert inner[0] == inner[1] and inner[0]


# 5


def test_licenses(spark, empty):
    t = licenses.TEMPLATES
    broken = t["MIT/text"].replace("sublicense", "lease").replace("merge, ", "")
    rows = [(1, "intro words here\n" + t["Apache-2.0/line"] + "\nmore text"), (2, "x " * 500 + broken + " tail"), (3, "licensed under nothing at all"), (4, None), (5, ""), (6, t["Apache-2.0/header"]), (None, t["CC-BY-NC-4.0/line"])]
    got = licenses.scan(spark.createDataFrame([(i, x, "", 1, "") for i, x in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("1", "Apache-2.0/line"), ("2", "MIT/text"), ("6", "Apache-2.0/header"), ("None", "CC-BY-NC-4.0/line")]
    texts = dict(rows)
    spans = {r.doc_id: texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode() for r in got}
    assert spans[1] == t["Apache-2.0/line"][:-1] and spans[2] == broken[:-1]
    assert next(r for r in got if r.doc_id == 2).coverage < 1
    assert licenses.scan(empty).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 15)
        n = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                n[i + 1, j + 1] = max(n[i, j + 1], n[i + 1, j], n[i, j] + (a[i] == b[j]))
        assert licenses.align(a, b, 0, 99)[0] == n[12, 15]


def test_alignment_stays_in_its_band():
    """Against the whole table with matches outside the band left out."""
    rng = np.random.default_rng(1)
    for turn in range(400):
        a, b = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 22))
        offset, band = int(rng.integers(-6, 12)), int(rng.integers(0, 6))
        n = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                n[i + 1, j + 1] = max(n[i, j + 1], n[i + 1, j], n[i, j] + (a[i] == b[j] and abs(j - i - offset) <= band))
        matched, first, last = licenses.align(a, b, offset, band)
        assert matched == n[-1, -1], turn
        if matched:
            assert 0 <= first < last <= len(b) and licenses.align(a, b[first:last], offset - first, band)[0] == matched


def test_license_scan_by_brute_force(spark):
    """All templates at all places of texts that hold whole, damaged, repeated and overlapping ones; a
    match has an indexed run."""
    rng = random.Random(8)
    names = sorted(licenses.TEMPLATES)
    index = licenses.Index(licenses.TEMPLATES)
    rows = []
    for i in range(12):
        words = [f"z{rng.randrange(90)}" for _ in range(rng.randrange(20))]
        for name in rng.sample(names, rng.randrange(3)):
            t = licenses.TEMPLATES[name].split()
            for _ in range(rng.choice([0, 0, 1, len(t) // 12])):
                t[rng.randrange(len(t))] = "damaged"
            words += t * rng.choice([1, 1, 2]) + [f"z{rng.randrange(90)}" for _ in range(rng.randrange(9))]
        rows.append((i, " ".join(words)))
    rows.append(rows[-1])
    got = Counter((r.doc_id, r.license, r.start_word, r.end_word, r.matched_words) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for i, text in rows:
        data, off = textops.text_buffers(pa.array([text]))
        h = textops.words(data, off, textops.ALNUM, lower=True)[3][0]
        every = [(p, t, 0) for t in range(len(index.words)) for p in range(-len(index.words[t]) // 5, len(h))]
        found = []
        for p, t, _ in every:
            w, band = index.words[t], max(3, len(index.words[t]) // 5)
            matched, first, last = licenses.align(w, h, p, band)
            if matched >= licenses.COVERAGE * len(w):
                found.append((matched, last - first, first, last, index.names[t]))
        taken = []
        for matched, _, a, z, name in sorted(found, key=lambda x: (-x[0], x[1], x[2], x[4])):
            if all(z <= x or y <= a for x, y in taken):
                taken.append((a, z))
                want[i, name] += 1
    assert Counter((i, name) for (i, name, *_), n in got.items() for _ in range(n)) == want


@pytest.mark.parametrize("name", ["MIT/line", "Apache-2.0/line", "CC-BY-NC-4.0/line", "GPL-3.0/line"])
def test_licenses_of_one_changed_word(spark, name):
    words = licenses.TEMPLATES[name].split()
    texts = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(len(words)) if sum(map(str.isalnum, words[i])) == len(words[i].rstrip(".,"))]
    df = spark.createDataFrame([(i, f"some words before {t} and after") for i, t in enumerate(texts)], "doc_id long, text string")
    assert texts and {r.doc_id for r in licenses.scan(df).collect() if r.license == name} == set(range(len(texts)))


# 6


def test_quality(spark, odd, empty):
    r = quality.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert r.where("predicted = quality").count() >= 0.95 * r.count()
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 5), (None, 1)], "doc_id long, quality int")
    got = quality.scores(quality.described(odd), quality.fit(quality.described(odd), labels)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert quality.scores(quality.described(empty), quality.fit(quality.described(empty), labels.limit(0))).count() == 0
    one = quality.scores(quality.described(odd), quality.fit(quality.described(odd), labels.where("quality = 1"))).first().score
    assert 0.5 < one < 1


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    d = quality.WIDTH
    x = [rng.normal(size=(400, d)) + 1, rng.normal(size=(600, d)) * 2]
    m = quality.Discriminant(np.array([400.0, 600.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), pool=0, ridge=0)
    q = rng.normal(size=(20, d))
    log = []
    for a in x:
        mu, cov = a.mean(0), np.cov(a.T, bias=True)
        log.append([-0.5 * (v - mu) @ np.linalg.solve(cov, v - mu) - 0.5 * np.linalg.slogdet(cov)[1] for v in q])
    want = 1 / (1 + np.exp(-(np.array(log[1]) - np.array(log[0]) + np.log(m.prior / (1 - m.prior)))))
    assert np.allclose(m.score(q), want, atol=1e-6)


# 7


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 3) if rng.random() < 0.2 else x for x in a] + [1] * rng.randint(0, 3)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        k = rng.randint(0, 14)
        assert near_dedup.edit_distance(list(a), list(b), k) == (row[-1] if row[-1] <= k else None)


def classes_by_brute_force(rows):
    words = {}
    for i, t, *_ in rows:
        if i is not None:
            words[i] = WORD.findall(t or "")
    ids = sorted(words)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if words[i] and words[j] and near_dedup.similar(words[i], words[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, root(i) if i is not None else None) for i, *_ in rows), key=repr)


def mutated(seed, groups=8, copies=6, edits=4):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.randrange(60, 160))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            rows.append((n, " ".join(w), "", 0, ""))
            n += 1
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), mutated(1)], ids=["odd", "mutated"])
def test_near_dedup(spark, rows):
    got = near_dedup.classes(spark.createDataFrame(rows, DOCS))
    assert rows_of(got, "doc_id", "class_id") == classes_by_brute_force(rows)


def test_near_dedup_of_ids_with_several_texts(spark):
    rows = clashing_rows()
    docs = spark.createDataFrame(rows, DOCS)
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if rows[i][0] is not None and rows[j][0] is not None and words[i] and words[j] and near_dedup.similar(words[i], words[j]) or rows[i] == rows[j]:
                group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    assert rows_of(near_dedup.classes(docs), "doc_id", "class_id") == sorted(((r[0], least[g]) for r, g in zip(rows, group)), key=repr)
    kept = near_dedup.without_duplicates(docs)
    assert kept.where("doc_id is null").count() == 1
    # One row of each class, with the class's smallest id; null and empty texts of an id are one.
    named = {g for r, g in zip(rows, group) if r[0] is not None and WORD.findall(r[1] or "")}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null and trim(text) != ''").collect()) == sorted(least[g] for g in named)


def test_near_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 100, 5), (1, "a b c d e f", 40, 6), (2, "g h i j k l", 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _nth int, key long")
    got = near_dedup.without_duplicates(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[1], rows[2]]


def test_near_dedup_filters(spark, odd, empty):
    assert near_dedup.classes(empty).count() == 0
    kept = near_dedup.without_duplicates(odd)
    assert kept.columns == odd.columns
    firsts = {i for i, c in classes_by_brute_force(odd_rows()) if i == c and i is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(firsts)
    assert kept.where("doc_id is null").count() == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 201 + i) for i in range(20)]
    got = {tuple(r) for r in CC.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {(x, root(x)) for x in linked}


# 8


def contaminated_by_brute_force(rows, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    patterns = []
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        patterns += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if n else []
    out = []
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for item, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    if item is not None:
                        found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_words", [400_000, 40])
def test_decontamination(spark, odd, empty, part_words):
    texts = [t for _, t, *_ in odd_rows() if t and len(t.split()) > 30]
    items = [(10, " ".join(texts[0].split()[5:30])), (9, "w1 W2"), (2, "naïve"), (None, " ".join(texts[3].upper().split()[:20])), (3, None), (4, ""), (10, "w3, w4;"), (5, "same " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(odd, bench, part_words=part_words)
    want = contaminated_by_brute_force(odd_rows(), items)
    assert rows_of(got, *decontamination.SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")) == want
    kept = decontamination.without_contaminated(odd, bench, part_words=part_words)
    assert kept.columns == odd.columns and rows_of(kept, "doc_id") == sorted(((x[0],) for x in want if not x[2]), key=repr)
    clashing = odd.withColumnsRenamed({"lang": "bad_id", "keys": "bad_row", "block": "row"})
    assert rows_of(decontamination.without_contaminated(clashing, bench, part_words=part_words), "doc_id") == rows_of(kept, "doc_id")
    assert decontamination.without_contaminated(odd, bench.limit(0), part_words=part_words).count() == len(odd_rows())
    assert decontamination.decontaminate(empty, bench, part_words=part_words).count() == 0
    none = decontamination.decontaminate(odd, bench.limit(0), part_words=part_words)
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(odd_rows())


def test_a_passage_in_a_long_document_is_dropped(spark):
    rng = random.Random(4)
    text = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage, rows = text(13), []
    for i in range(20):
        w = text(4000)
        if i % 2:
            w[100 * i : 100 * i] = passage
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    assert decontamination.decontaminate(docs, bench).where("contaminated").count() == 0
    assert rows_of(decontamination.without_contaminated(docs, bench), "doc_id") == [(i,) for i in sorted(range(0, 20, 2), key=lambda i: repr((i,)))]


def test_words_are_compared_not_their_fingerprints(monkeypatch):
    """With fingerprints of two values only equal words still count."""
    words = textops.words

    def coarse(*a, **k):
        *rest, h = words(*a, **k)
        return *rest, [x & np.uint64(1) for x in h]

    monkeypatch.setattr(decontamination.T, "words", coarse)
    items = [(1, "a b c"), (2, "d"), (3, "É"), (4, "the longer word")]
    rows = [(1, "A b c a c b"), (2, "d e f"), (3, "é É"), (4, "the longest word"), (5, "")]
    searches, got = decontamination._patterns(items, 13), []
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    decontamination._scan(batch, searches, lambda i, n, hit, found: got.append((rows[i][0], *decontamination._verdict(n, int(hit.sum()), found))))
    assert sorted(got, key=repr) == contaminated_by_brute_force(rows, items)


# 9


def test_toxicity(spark, odd, empty):
    r = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").withColumnRenamed("toxic", "said").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    assert r.where("toxic = 1 and said").count() >= 0.85 * r.where("toxic = 1").count()
    assert r.where("toxic = 0 and said").count() <= 0.005 * r.where("toxic = 0").count()
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.severities(odd, model).count() == len(odd_rows())
    assert toxicity.severities(empty, toxicity.fit(empty, labels)).count() == 0
    none = toxicity.fit(odd, labels.limit(0))
    assert toxicity.severities(odd, none).where("toxic or expected_severity > 0").count() == 0
    assert toxicity.without_toxic(odd, none).count() == len(odd_rows())


def test_ordinal_grades_share_weights():
    rng = np.random.default_rng(0)
    n, grade, pairs = 600, rng.integers(0, 4, 600), []
    for i, g in enumerate(grade):
        pairs += [(i, c) for c in range(10 * 1) if c < 3 * g] + [(i, 50 + int(rng.integers(0, 40)))]
    row, column = np.array(sorted(set(pairs))).T
    m = toxicity.Ordinal(128).fit(row, column, grade)
    p = m.above(row, column, n)
    assert m.edges.shape == (3,) and (np.diff(m.edges) >= 0).all()
    assert (np.diff(p, axis=1) <= 1e-12).all()
    assert np.abs(p.sum(1) - grade).mean() < 0.4


# 10


def brute(ids, x, best):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = [(-float(nearest.exact(x[j], x[i])), int(ids[j])) for j in range(len(x)) if ids[j] != ids[i]]
        out.setdefault(int(ids[i]), sorted(s)[:best])
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_nearest_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    e = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.array(e["embedding"].tolist(), float), e["vec_id"].to_numpy()
    got = nearest.op10_nearest(spark, d).collect()
    want = {q: {i for _, i in s} for q, s in brute(ids, x, 20).items()}
    found = Counter(r.query_id for r in got if r.vec_id in want[r.query_id])
    assert sum(found.values()) >= 0.9 * sum(map(len, want.values()))
    assert all(r.score == float(nearest.exact(x[ids == r.vec_id][0], x[ids == r.query_id][0])) for r in got[:50])


def test_nearest_scores_a_share_of_the_pairs(spark):
    """The tables leave out most pairs of vectors that hardly cluster, at a recall over 0.9."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.array(e["embedding"].tolist(), float)
    x, q = x, x[::20]
    mask = nearest.candidates(nearest.Tables(x.shape[1] + 1), x, q, float(np.sqrt((x * x).sum(1)).max()))
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1:21]
    assert mask.mean() < 0.45 and np.take_along_axis(mask, best, 1).mean() >= 0.9


def test_nearest_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 1) for i in range(1, 40)]
    rows += [(40, [1.0] * 8, 1), (41, [1.0] * 8, 1), (42, [1.0] * 8, 1), (60, None, 1), (80, [0.0] * 8, 1), (100, [float("nan")] * 8, 1), (120, [None] + [1.0] * 7, 1), (140, [float("inf")] + [1.0] * 7, 1), (160, [1.0] * 3, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    got = nearest.search(df, F.col("vec_id") % 20 == 0, best=5, tables={"width": 1e6})
    good = [(i, v) for i, v, _ in rows if i is not None and i <= 42]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(float)
    want = brute(ids, x, 5)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in by.items()} == want
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n,scale,seed", [(1000, 100, 0), (1000, 100, 1), (15, 1, 0), (2000, 1, 2)])
def test_nearest_fills_all_rows_at_any_norm(spark, n, scale, seed):
    x = np.random.default_rng(seed).normal(size=(n, 64)).astype(np.float32).astype(float)
    x[7] *= scale
    if n == 2000:  # norms over four orders of magnitude
        x *= np.logspace(0, 4, n)[np.random.default_rng(seed).permutation(n), None]
    ids = np.arange(n)
    got = {}
    for r in nearest.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: {i for _, i in s} for q, s in brute(ids, x, 20).items()}
    assert {q: len(s) for q, s in got.items()} == {q: min(20, n - 1) for q in want}
    assert sum(len(got[q] & s) for q, s in want.items()) >= 0.9 * sum(map(len, want.values()))


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = B.written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            after = {r.doc_id for r in docs.select("doc_id").collect()}
            assert after <= before
            before = after
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == before
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with each stage's cases: toxic rows, copies and near copies, a shared passage, a benchmark
    passage in a long row, and odd rows. Returns (folder, ids by case)."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"k{rng.randrange(5000)}" for _ in range(n))
    bad = [f"vile{i}" for i in range(6)]
    rows, labels, ids = [], [], {"toxic": set(), "copy": set(), "near": set(), "passage": set(), "leak": set(), "clean": set()}
    passage, leak = text(70), text(20)

    def add(case, body):
        rows.append((len(rows), body, "en", "src", len(body or "")))
        ids[case].add(rows[-1][0])

    for i in range(160):
        w = text(rng.randrange(40, 90)).split()
        if i % 2:
            for x in bad:
                w.insert(rng.randrange(len(w)), x)
        add("toxic" if i % 2 else "clean", " ".join(w))
        labels.append((rows[-1][0], 1, i % 2))
    base = rows[0][1]
    add("copy", base)
    near = base.split()
    near[7] = "changed"
    add("near", " ".join(near))
    add("clean", text(30) + " " + passage)
    add("passage", text(40) + " " + passage + " " + text(40))
    add("leak", text(1500) + " " + leak + " " + text(1500))
    for odd_text in (None, "", " \t"):
        add("clean", odd_text)
    rows.append((None, text(20), None, None, None))
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_nth", F.lit(1)).withColumn("key", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, ids


def test_pipeline_decisions_take_effect(spark, planted):
    import corpus_pipeline

    folder, ids = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {"toxicity": ids["toxic"], "near_dedup": ids["copy"] | ids["near"], "substring_dedup": set(), "decontamination": ids["leak"]}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = B.written(stage(spark, docs, folder), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in docs.collect()}
        assert before.keys() - after.keys() == gone[name], name
        changed = {i for i in after if after[i] != before[i]}
        assert changed == (ids["passage"] if name == "substring_dedup" else set()), name
        if changed:
            (i,) = changed
            assert len(after[i].split()) == 80 and docs.where(F.col("doc_id") == i).first()["n_chars"] == len(after[i])
        before = after
    pieces = B.written(corpus_pipeline.packed(spark, docs, folder), "pieces")
    tokens = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in tokens} == before.keys() and all(r.n == r["all"] for r in tokens)


def test_pipeline_stages_of_empty_tables(spark, planted):
    import corpus_pipeline

    folder, _ = planted
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_text_primitives():
    texts = ["a bb", "", "  x\ty ", "ünï z", None, "q"]
    data, off = textops.text_buffers(pa.array(texts))
    starts, ends, first, (h,) = textops.words(data, off, textops.SPACED)
    assert [data[s:e].tobytes().decode() for s, e in zip(starts, ends)] == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [2, 0, 2, 2, 0, 1]
    assert len(set(h.tolist())) == 7
    assert list(textops.slices(off, 4)) and [r for a in textops.slices(off, 4) for r in range(*a)] == list(range(6))
