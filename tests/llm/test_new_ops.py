"""Operators 11 to 13 against plain Python, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm import bitmodel
from recordloom.llm import op11_lm as op11
from recordloom.llm import op12_spelling as op12
from recordloom.llm import op13_align as op13

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "one", "one", "one two", "  a  b\n\n c\td ", "x" * 30_000 + " tail" * 5000, "é漢🙂 a▁b <|endoftext|> don't", "é漢🙂 <|endoftext|> don't<s></s><0x41>", "it's\r\nDON'T no;\r\n", "\n\n  \n", "\0﻿", "ﬁ İ é", "▁"]
SCHEMA = "doc_id long, text string, row int, pairs string, n int, word string, token string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 4 else i % 9, t, 1, "x", 2, "y", "z") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- 13: alignment of two tokenizers -----------------------------------------------------


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def plain_alignment(texts):
    """What op13 promises, from whole texts and the libraries alone."""
    import sentencepiece

    tokenizer, of = Tokenizer.from_file(A_PATH), byte_of()
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    out, holders = [], defaultdict(int)
    for text in texts:
        empty = dict(n_a=0, n_b=0, n_groups=0, n_links=0, text="", links=Counter())
        out.append(empty)
        if not text:
            continue
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        a_bytes = [bytes(of[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        while i < len(a):
            x, y = i + 1, j + 1
            while a_ends[x - 1] != b_ends[y - 1]:
                if a_ends[x - 1] < b_ends[y - 1]:
                    x += 1
                else:
                    y += 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        for pair in links:
            holders[pair] += 1
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out[-1] = dict(n_a=len(a), n_b=len(b), n_groups=len(groups), n_links=sum(links.values()), text=hashlib.sha256(text.encode()).hexdigest(), links=links)
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    return [
        (o["n_a"], o["n_b"], o["n_groups"], o["n_links"], sum(n for p, n in o["links"].items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in o["links"].items()), o["text"])
        for o in out
    ]


def check_alignment(frame, limit):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    want = Counter((d, *values) for (d, _), values in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    got = op13.align_documents(frame, A_PATH, B_PATH, limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("limit", [1, 300, op13.FREQUENT])
def test_alignment(docs, odd, limit):
    """Whatever share of the pairs is broadcast."""
    check_alignment(docs, limit)
    check_alignment(odd, limit)
    assert op13.align_documents(odd.filter("false"), A_PATH, B_PATH, limit).count() == 0


def test_alignment_query(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, *values) for (d, _), values in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in op13.op13_cross_tokenizer(spark, SF).collect()) == want


def test_parts_of_random_texts_align_as_whole_texts(spark):
    rng = np.random.default_rng(7)
    bits = ["a", "İ", " ", "  ", "\n", "\r", "\t", "word", "Don't", "'s", ",", ".\r", "1", "é", "漢", "🙂", " ", "　", "\0", "<s>", "é", "ß", "}", "▁"]
    texts = ["".join(bits[rng.integers(len(bits) - (k % 10 > 0))] for _ in range(rng.integers(1, 20))) for k in range(1500)]
    check_alignment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), op13.FREQUENT)


def test_few_kept_parts_give_the_same_alignments(docs):
    texts = [r.text for r in docs.limit(40).collect()]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    one, few = op13.Aligner(A_PATH, B_PATH), op13.Aligner(A_PATH, B_PATH, kept=50)
    for _ in range(2):
        for x, y in zip(one.slice(data, offsets), few.slice(data, offsets), strict=True):
            assert list(map(str, x)) == list(map(str, y))


# ---- 12: spelling variants ---------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def plain_variants(words):
    letters = sorted(set("".join(words)))
    near = {w: {e for e in edits(w, letters) if e in words and e != w} for w in words}
    forms = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 5 * words[w]:
                forms[w] = best
    out = Counter()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))] += 1
    return out


def test_spelling_query(spark, docs):
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    got = op12.op12_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(tuple(r) for r in got.collect()) == plain_variants(words)
    assert len(words) > 500


@pytest.mark.parametrize("block", [7, op12.BLOCK])
def test_variants_of_crowded_groups(spark, block):
    """Words over few letters, so that groups are large and pairs share both halves; blocks change nothing."""
    rng = np.random.default_rng(3)
    rows = []
    for doc_id in range(60):
        picked = ["".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(400)]
        rows.append((doc_id, " ".join(w.upper() if rng.random() < 0.2 else w for w in picked)))
    rows += [(60, "common1 " * 3), (61, ("prefix " * 6 + "prefixe " * 40 + "préfixe " * 300)), (62, "aaaaaaaaaa " * 25 + "aaaaaaaaa " * 5 + "aaaaaaaaaaa " * 125)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(plain_words(rows))
    assert Counter(tuple(r) for r in op12.spelling_variants(frame, block).collect()) == want
    assert any(root not in (w, form) for w, form, root, *_ in want)  # a chain of forms


def test_spelling_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(None, "Nullable " * 9), (7, "Ünïcödé " * 1200), (8, "x" * 200 + " "), (8, ("y" * 70 + " ") * 5), (9, "straße groß× größer " * 7)]
    rows += [(k, "deletion " * 2 + "z" * 80) for k in range(1000)]
    frame = spark.createDataFrame([(*r, "w", 1, "r") for r in rows], "doc_id long, text string, word string, n int, root string")
    want = plain_words(rows)
    assert {r.word: r.n for r in op12.word_counts(frame).collect()} == want
    assert Counter(tuple(r) for r in op12.spelling_variants(frame).collect()) == plain_variants(want)
    assert op12.spelling_variants(frame.filter("false")).count() == 0


# ---- 11: language-model scores -----------------------------------------------------------

BLANK = "[ \\t-\\r]"


def plain_units(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(f"^{BLANK}+|[^ \\t-\\r]+{BLANK}*", text)
    return found if text and not re.search(f"{BLANK}$", text) else [*found, ""]


def plain_base(rows):
    train = Counter()
    held = [d is None or zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    tokens = [[*re.findall("[^ \\t-\\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    for own, out in zip(tokens, held, strict=True):
        if not out:
            train.update(own)
    total = sum(train.values())
    norm = total + 0.5 * (len(train) + 1)
    return [(d, out, len(own), sum(train[t] > 0 for t in own), total, sum(math.log10((train[t] + 0.5) / norm) for t in own)) for (d, _), out, own in zip(rows, held, tokens, strict=True)]


def plain_scores(spark, frame, group):
    """log10 of each text's probability, unit after unit, from the units' own probabilities."""
    classes = op11.classes_of(frame, group) if group is not None else []
    found = op11.unit_counts(frame, group, classes).cache()
    names = ["n", *(f"n{e}" for e in range(len(classes)))]
    rows = found.collect()
    totals = [(sum(r[c] for r in rows), sum(r[c] > 0 for r in rows)) for c in names]
    codes = spark.sparkContext.broadcast(op11.bit_tables(found))
    logs = {r.unit: r.logs for r in op11.unit_logs(found, codes, *op11.mixing_weights(found, codes), totals).collect()}
    scores = []
    for row in frame.select("text").collect():
        belief = np.zeros((len(names), len(op11.MEMORIES)))
        past = Counter()
        for t, unit in enumerate(plain_units(row.text)):
            mine = np.exp(np.array(logs[unit]))[:, None]
            share = np.array(op11.MEMORIES)
            if past[unit]:
                belief += np.log((1 - share) * mine + share * past[unit] / (t + op11.MEMORY))
            else:
                belief += np.array(logs[unit])[:, None] + np.log1p(-share)
            past[unit] += 1
        scores.append((belief.max() + np.log(np.exp(belief - belief.max()).mean())) / np.log(10))
    return scores


@pytest.mark.parametrize("limit", [0, 40, op11.BROADCAST])
def test_scores_are_those_of_a_sequential_reader(spark, docs, odd, limit):
    """Base columns against plain Python; scores against unit after unit, whatever share of the units is broadcast."""
    few = docs.limit(60).select("doc_id", "text", "lang")
    frame = few.unionByName(odd.select("doc_id", "text", F.lit("x").alias("lang"))).unionByName(few.limit(2)).cache()
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = op11.score_documents(frame, F.col("lang"), limit).collect()
    want = [(*values, score) for values, score in zip(plain_base(rows), plain_scores(spark, frame, F.col("lang")), strict=True)]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(*(sorted(v, key=lambda r: (str(r[0]), r[2], -r[6])) for v in (got, want)), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)
    assert op11.score_documents(frame.filter("false"), F.col("lang"), limit).count() == 0


def test_scores_without_training_documents(spark):
    frame = spark.createDataFrame([(None, "a b", None, 3), (None, None, None, 4)], "doc_id long, text string, lang string, n int")
    got = op11.score_documents(frame, F.col("lang")).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(True, 3, 0, 0, 0.0), (True, 1, 0, 0, 0.0)}
    assert all(r.score < 0 for r in got)


def test_language_model_query(spark, docs):
    """Documents that were not learned from take fewer bits than under the base, whose unknown words are not even spelled out."""
    got = op11.op11_lm_scoring(spark, "/root/testdata/sf0.1").cache()
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = got.filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int")), F.sum("n_bytes")).first()
    assert held[0] > 0.95 * held[1] and held[2] > 0.75
    assert -held[0] * math.log2(10) / held[3] < 2.15  # bits a byte


def test_shuffled_letters_cost_more(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    mixed = [(5_000_000 + d, " ".join("".join(rng.permutation(list(w))) for w in t.split(" ")), None) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 5 == 1]
    mixed = [(next(k for k in range(10**9 + 1000 * i, 10**9 + 1000 * i + 1000) if zlib.crc32(str(k).encode()) % 5 == 1), t, g) for i, (_, t, g) in enumerate(mixed)]
    frame = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    bits = {r.doc_id: r.bits_per_byte for r in op11.score_documents(frame, F.col("lang")).filter("held_out").collect()}
    usual = [b for d, b in bits.items() if d < 10**9]
    assert np.mean([b for d, b in bits.items() if d >= 10**9]) > np.mean(usual) + 0.5


def test_the_bit_model_is_a_probability():
    """Over all units of two bytes, probabilities add up to one, but for what goes on after a blank."""
    rng = np.random.default_rng(2)
    words = ["the ", "then ", "than\n", "there  ", "other", "a "] * 20
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    table = np.zeros(2 * bitmodel.SLOTS, dtype=np.int64)
    events = bitmodel.Events(data, offsets)
    bitmodel.count(events, rng.integers(1, 50, len(words)), table)
    mixer = bitmodel.Mixer(bitmodel.coded(table[0::2], table[1::2]))
    weights, _, refining = mixer.learn([(events, np.ones(len(words), dtype=np.int64))])
    mixer.settle(weights, refining)
    first, second = np.divmod(np.arange(1 << 16), 256)
    every = np.stack([first, second], axis=1).astype(np.uint8).ravel()
    p = np.exp2(-mixer.cost(bitmodel.Events(every, np.arange(0, len(every) + 1, 2)), 1 << 16))
    ended = np.isin(first, list(b" \t\n\v\f\r"))
    assert 0.9 < p.sum() <= 1 + 1e-5
    goes_on = p[np.isin(second, list(b" \t\n\v\f\r")) & ~ended].sum()
    assert p[~ended & ~np.isin(second, list(b" \t\n\v\f\r"))].sum() + goes_on <= 1
