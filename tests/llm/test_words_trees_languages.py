"""Spelling variants, the conversation prefix trie and language masks: brute force, held-out accuracy, odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import language_masks, prefix_trie, queries, spelling_variants

DOCS = "doc_id long, text string, lang string, word string, id string, n long"


# --- spelling variants --------------------------------------------------------------

def brute_words(docs, min_length=6, min_count=5, thin_every=199):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if thin_every and h % thin_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}


def brute_variants(words, ratio=5):
    near, groups = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            groups[i, len(w), cut].add(w)
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for g in groups.values():
        for w in g:
            near[w] |= g - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * n:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def as_dict(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("levels", [32, 5])
def test_variants_match_brute_force(spark, levels, monkeypatch):
    monkeypatch.setattr(spelling_variants, "TRIE_LEVELS", levels)
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 4, 5, 6]))): rng.choice([1, 5, 6, 30, 200, 2000])
             for _ in range(300)}
    words |= {"a" * k: 5 ** (k % 4) for k in range(1, 14)}  # runs of one letter share every prefix
    words |= {"x" * 30 + "yy": 7, "x" * 29 + "yy": 50, "x" * 30 + "yz": 9, "q" * 40: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = spelling_variants.neighbours(df)
    assert pairs.count() == pairs.distinct().count()
    assert as_dict(spelling_variants.variants(df, pairs)) == brute_variants(words)


def test_word_counts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", 7)
    rng = random.Random(7)
    vocabulary = ["Größen", "größen", "Straßen", "colour", "COLOUR", "kolour", "colours", "ÉTUDES", "étudeS", "short", "a" * 50]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "!?", "colour-colour", "colour" * 400, texts[0], texts[0]]
    rows = [(None if i % 11 == 0 else i // 2, t, None, "word", "id", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)  # word, id and n clash with names used inside
    for every in (199, 3, None):
        got = {r.word: r.n for r in spelling_variants.count_words(docs, thin_every=every).collect()}
        assert got == brute_words([r[:2] for r in rows], thin_every=every)
    whole = {r.word: r.n for r in spelling_variants.count_words(docs).collect()}
    monkeypatch.setattr(spelling_variants, "LONG_TEXT", 10)
    assert {r.word: r.n for r in spelling_variants.count_words(docs).collect()} == whole


def test_no_words(spark):
    empty = spark.createDataFrame([(1, None, None, None, None, None)], DOCS)
    words = spelling_variants.count_words(empty)
    assert spelling_variants.variants(words, spelling_variants.neighbours(words)).collect() == []


# --- prefix trie --------------------------------------------------------------------

def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[:len(node)] == node]
        leaf = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
                    sum(len(x) == len(node) + 1 for x in below), len(leaf),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, pos long, tie string, turn_id string"


def random_turns(seed, convs=140):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), 200, 305, 405, -3, -104]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, None if t == 0 and rng.random() < .2 else t, rng.choice(["user", "assistant", None]),
                         rng.choice(["hi", "ho", "", None, "日本", "hi"])))
        if c % 4 == 0:  # copies, equal turns and repeated rows
            rows += [(c, 3, "user", "b"), (c, 3, "user", "a"), (c, 3, "user", "a"), (c, 3, None, None)]
    rows += [(400 + k, t, "user", "same") for k in range(1, 30) for t in range(4)]
    rows += [(None, 1, "user", "nobody's")] * 3
    return rows


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_trie_matches_brute_force(spark, seed, small, monkeypatch):
    if small:  # many slices, shards and pieces
        monkeypatch.setattr(prefix_trie, "SLICE", 2)
        monkeypatch.setattr(prefix_trie, "SHARD_ELEMENTS", 9)
        monkeypatch.setattr(prefix_trie, "PIECE_BITS", 2)
    rows = random_turns(seed)
    df = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], TURNS)
    got = prefix_trie.prefix_trie(*queries.rebuilt_turns(prefix_trie.numbered(df)))
    assert got.columns == TRIE
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(brute_rebuilt(rows))


def test_one_long_conversation_and_a_comb(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 16)
    rows = [(0, t, "user", f"t{t}") for t in range(120)]
    rows += [(100 * k, t, "user", f"t{t}") for k in range(1, 30) for t in range(k)]  # each a prefix of the long one
    rows += [(100 * k, t, "user", f"t{t}" if t < k else "else") for k in range(30, 50) for t in range(k + 1)]
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], TURNS)
    got = prefix_trie.prefix_trie(*queries.rebuilt_turns(prefix_trie.numbered(df)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(brute_rebuilt(rows))


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "user", "x", 0, "", "")]):
        df = spark.createDataFrame(rows, TURNS)
        assert prefix_trie.prefix_trie(*queries.rebuilt_turns(prefix_trie.numbered(df))).collect() == []
    c = next(c for c in range(701, 800) if zlib.crc32(str(c).encode()) % 6)  # no base: no turns left
    alone = spark.createDataFrame([(c, 0, "user", "x", 0, "", "")], TURNS)
    (r,) = prefix_trie.prefix_trie(*queries.rebuilt_turns(prefix_trie.numbered(alone))).collect()
    assert tuple(r) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_parentheses():
    rng = random.Random(3)
    for n in (1, 5, 200, 3000):
        bits, depth = [1], 1
        while len(bits) < 2 * n or depth > 1:
            up = depth == 1 or (len(bits) < 2 * n and rng.random() < rng.choice([.3, .7]))
            bits.append(int(up))
            depth += 1 if up else -1
        bits.append(0)
        seq = prefix_trie.Parentheses(np.array(bits, np.uint8))
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.array(sorted(close))
        assert seq.find_close(opens).tolist() == [close[i] for i in sorted(close)]


# --- language masks -----------------------------------------------------------------

def brute_ngrams(text):
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i:i + n]
            if (n == 1 and g != " ") or (n == 2 and g != "  ") or (n == 3 and g[1] != " "):
                out[g] += 1
    return out


def number(gram):
    v = 0
    for c in gram:
        v = v << 21 | ord(c)
    return v


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_ngrams_match_brute_force(spark, piece, monkeypatch):
    monkeypatch.setattr(language_masks, "PIECE", piece)
    texts = ["Grüße aus Köln!", "", None, "a", "  x1y2 z ", "日本語 text", "\U00020000 İstanbul", "ab" * 30, "ab" * 30, "1 2 3"]
    langs = ["de", "de", "de", "en", "en", None, "fr", "fr", "fr", "en"]
    docs = spark.createDataFrame(list(zip(texts, langs)), "text string, lang string")
    got = {(r.lang, r.gram): r.n for r in language_masks.count_ngrams(docs.filter("lang is not null"), "text", "lang").collect()}
    want = Counter()
    for t, lang in zip(texts, langs):
        if lang:
            for g, n in brute_ngrams(t or "").items():
                want[lang, number(g)] += n
    assert got == dict(want)


def test_filters_hold_what_they_got_and_counts_are_corrected():
    rng = np.random.default_rng(5)
    names = tuple(f"l{i}" for i in range(11))  # more bits than one byte
    gram = rng.integers(1 << 40, size=4000)
    who = rng.integers(len(names), size=4000)
    share = np.where(rng.random(4000) < .5, 2e-3, 2e-4)
    m = language_masks.filters(names, [names[i] for i in who], gram, share)
    assert m.table.shape[0] == 3
    masks = [m.masks(gram.astype(np.uint64), g) for g in range(3)]
    for i in range(4000):
        bit = who[i] * 2 + 1
        assert masks[bit // 8][i] >> (bit % 8) & 1
        assert (masks[bit // 8 if bit % 8 else bit // 8][i] >> ((bit - 1) % 8) & 1) or share[i] < 1e-3
    other = rng.integers(1 << 41, 1 << 42, size=200_000).astype(np.uint64)
    seen = np.array([(m.masks(other, b // 8) >> (b % 8) & 1).mean() for b in range(22)])
    assert np.allclose(seen, m.false, atol=5e-4)


def test_language_decisions_and_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "the dog that barks", "en"),
            (4, None, "en"), (5, "", "de"), (6, "12 34 !", "de"), (7, "the the the", None), (8, "日本", None), (9, "the cat", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, LANGUAGE string, score double")
    model = language_masks.train(docs)
    assert model.languages == ("de", "en") or model.languages == ("en", "de")
    out = language_masks.identified(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "language"]  # the clashing column is replaced
    got = {r.doc_id: tuple(r.language) for r in out.collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6, 7, 9)] == ["en", "de", "en", "und", "und", "und", "en", "en"]
    assert got[8] == (model.languages[0], 0.0) and got[4][1] == got[6][1] == 0.0
    assert all(0 <= s <= 1 for _, s in got.values())
    none = language_masks.train(docs.filter("lang = 'xx'"))
    assert {tuple(r.language) for r in language_masks.identified(docs, none).collect()} == {("und", 0.0)}
    assert language_masks.identified(docs.limit(0), model).collect() == []


def test_held_out_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op12_language_id"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = out.collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.99


def test_sample_keeps_small_languages_whole(spark):
    docs = spark.range(3000).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"),
                                    F.when(F.col("id") < 20, "rare").otherwise("common").alias("lang"))
    small = language_masks.train(docs, sample_docs=50)
    assert set(small.languages) == {"rare", "common"}
    got = {r.language.lang for r in language_masks.identified(docs.limit(5), small).collect()}
    assert got <= {"rare", "common"}


# --- packing: ids of odd texts --------------------------------------------------------

def test_grouped_word_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from sitelens.llm import packing

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    whole, encoder = Tokenizer.from_str(vocabulary), packing.Encoder(vocabulary)
    whole.encode_special_tokens = True
    rng = random.Random(1)
    chars = [chr(c) for c in range(1, 0x260)] + list("ⱥⱦ \x0b\x1c　́日本İß’ſ😀<|>") + [" "] * 120 + list("abcdefghij'st") * 10
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(300))) for _ in range(400)]
    texts += ["", "  ", "<|endoftext|>", " ȺȾ Ⱥa1 İx don't CAN'T we'll", "İ̇", "a" * 5000, "á"]
    for at in range(0, len(texts), 37):
        some = texts[at:at + 37]
        for text, ids in zip(some, encoder.encode_all([t.encode() for t in some])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert encoder.encode_all([]) == []
