"""Operators 3 to 6 and 9 and the pipeline against plain Python, and their edge cases."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from recordloom.llm import op3_packing as op3
from recordloom.llm import op4_binary as op4
from recordloom.llm import op5_sentencepiece as op5
from recordloom.llm import op6_jaccard as op6
from recordloom.llm import op7_quality as op7
from recordloom.llm import op9_exact as op9
from recordloom.llm import op10_langid as op10
from recordloom.llm import rangecoder
from recordloom.llm.encoding import PartEncoder, crc32_join
from recordloom.llm.textops import word_hash
from recordloom.operators.storage import new_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", "one", "one", "  a  b\n\n c\td ", "x" * 30_000 + " tail" * 5000, "é漢🙂 ▁ <|endoftext|> don't", "it's\r\nDON'T\u00a0no"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 4 else i % 6, t, "x", 1, "b", 2, 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, h int, band string, rep int, length int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library_ids(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_parts_give_the_library_ids(docs, name, blanks):
    texts = ODD + [r.text for r in docs.collect()]
    assert PartEncoder(public_tokenizers.path(name), blanks).encode(texts) == library_ids(name, texts)


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_random_texts_of_all_kinds_of_characters(name, blanks):
    rng = np.random.default_rng(11)
    kinds = defaultdict(list)
    for code in [*range(0x2FF0), *range(0x3000, 0x3100), *range(0xAC00, 0xAC40), *range(0x1F600, 0x1F620)]:
        if not 0xD800 <= code < 0xE000:
            kinds[unicodedata.category(chr(code))[0]].append(chr(code))
    own = ["İ", "İstanbul", " <|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\u212a", "e\u0301", "'s", "'T", "don't", " ", "  ", "\n", "\u0085", "\u00a0", "ß", "ŉ", "a", "Z", "9"]
    texts = []
    for _ in range(4000):
        picked = [own[rng.integers(len(own))] if rng.random() < 0.4 else (k := kinds["LMNZPSC"[rng.integers(7)]])[rng.integers(len(k))] for _ in range(rng.integers(1, 12))]
        texts.append("".join(picked))
    texts += ["a <|endoftext|> b", "İ", "<|startoftext|>x", "x<|endoftext|>"]
    want = library_ids(name, texts)
    got = PartEncoder(public_tokenizers.path(name), blanks).encode(texts)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def test_words_that_a_polynomial_hash_confuses(spark):
    """Two words of 1,024 letters that hash alike under every polynomial modulo 2**64."""
    one, two = thue_morse(1024)
    low, high = word_hash([one, two])
    assert low != high
    frame = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in op6.near_duplicates(frame).collect()} == {(1, 1, 0), (2, 2, 0)}
    data = np.frombuffer(f"{one}\n{two}".encode(), dtype=np.uint8)
    counts, _, _ = op7.base_counts(data, np.array([0, len(data)]))
    assert [int(c[0]) for c in counts] == [2, 2048, 0, 0, 0]


def test_hashes_do_not_depend_on_the_place():
    words = ["", "a", "abcdefgh", "abcdefghi", "x" * 100, "abcdefg\0", "abcdefg"]
    whole = word_hash(words)
    assert len(set(whole.tolist())) == len(words)
    for w, h in zip(words, whole, strict=True):
        assert word_hash(["zz", w, "y"])[1] == h


def test_crc_of_joined_parts():
    for a, b in ((b"", b""), (b"x", b""), (b"", b"abc"), (b"hello" * 99, b"world" * 1000)):
        assert crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def check_packing(rows, texts, capacity):
    ids = [i + b"\0\0\0\0" for i in library_ids("byte_bpe_50k.json", [t for _, t in texts])]
    want = Counter()
    for (doc_id, _), own in zip(texts, ids, strict=True):
        n = len(own) // 4
        first = n if n <= capacity else n % capacity or capacity
        bounds = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
        for piece, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            want[doc_id, piece, a, b - a, zlib.crc32(own[4 * a : 4 * b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(len(i) // 4 for i in ids) // capacity)


def test_packing(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    used, least = check_packing(op3.op3_best_fit_packing(spark, SF).collect(), texts, op3.CAPACITY)
    assert used <= 1.03 * least + 1
    check_packing(op3.pack_documents(odd, path, 64).collect(), [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert op3.pack_documents(odd.filter("false"), path).count() == 0
    few, many = ({tuple(r) for r in op3.pieces(docs, path, kept=n).collect()} for n in (500, op3.KEPT_PARTS))
    assert few == many
    placed = op3.pack_documents(docs, path, 256, with_ids=True)
    lengths = {r.sequence_id: len(r.ids) // 4 for r in op3.packed_sequences(placed).collect()}
    assert max(lengths.values()) <= 256 and sum(lengths.values()) == placed.agg(F.sum("length")).first()[0]


def test_plan_packs_every_counted_length():
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 513, 40_000), minlength=513)
    plan = op3.packing_plan(histogram)
    assert {k: v for k, v in plan.used.items() if v} == {int(k): int(histogram[k]) for k in np.flatnonzero(histogram)}
    least = -(-int((np.arange(513) * histogram).sum()) // 512)
    assert least <= plan.sequences <= 1.01 * least + 1
    fitted = op3.fit_repeats(some := op3.patterns(histogram), histogram)
    assert (fitted >= 0).all() and len(some) == len(fitted)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 257, 5000, rangecoder.BLOCK_IDS // 8])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 49_408).astype(np.int64)
    block = rangecoder.encode_block(ids)
    assert (rangecoder.decode_block(block) == ids).all()
    if n > 1000:
        repeated = np.tile(ids[:100], n // 100)
        assert len(rangecoder.encode_block(repeated)) < len(repeated)
        for at in (len(block) // 2, len(block) - 1):
            broken = bytearray(block)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                rangecoder.decode_block(bytes(broken))


def check_files(spark, frame, monkeypatch=None):
    folder = new_path(spark, "ids")
    manifest = op4.write_ids(frame, public_tokenizers.path("word_bpe_49k.json"), folder)
    got = op4.read_documents(manifest, folder).collect()
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    ids = [i + b"\1\0\0\0" for i in library_ids("word_bpe_49k.json", [t for _, t in rows])]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i) // 4, zlib.crc32(i)) for (d, _), i in zip(rows, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_token_files(spark, docs, odd):
    check_files(spark, docs)
    check_files(spark, odd)
    check_files(spark, odd.filter("false"))
    giant = spark.createDataFrame([(1, "a b"), (2, "c d " * 300_000), (3, "e"), (None, "f g " * 200_000)], "doc_id long, text string")
    check_files(spark, giant.coalesce(1))  # documents that span blocks


@pytest.fixture(scope="module")
def vocabulary():
    return op5.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def brute_best(vocabulary, text):
    """The largest sum of scores over all segmentations, by plain recursion from the left."""
    best = [0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        sums = [best[s] + vocabulary.weights[text[s:end]] for s in range(max(0, end - 16), end) if text[s:end] in vocabulary.weights]
        if text[end - 1] not in vocabulary.weights:
            sums.append(best[end - 1] + vocabulary.unknown)
        best[end] = max(sums)
    return best[-1]


def test_best_segmentation(vocabulary, docs):
    for word in {w for r in docs.limit(30).collect() for w in r.text.split()}:
        text = op5.marked(word)
        assert vocabulary.part(text)[1] == brute_best(vocabulary, text)


def test_library_agrees_on_words(vocabulary, docs):
    """The library's unigram mode over the same file; single words, where its 32-bit sums are exact."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = sorted({w for r in docs.collect() for w in r.text.split()})
    same = sum(np.frombuffer(vocabulary.encode(op5.marked(w)), dtype="<u4").tolist() == library.encode(w) for w in words)
    assert same > 0.99 * len(words)  # the rest are ties


def test_chunks_equal_the_whole(vocabulary, docs):
    texts = [r.text[:700] for r in docs.limit(12).collect()] + [t for t in ODD if t and len(t) < 1000]
    texts += ["a" * 300 + " " + "b" * 40, " " * 90 + "x", "漢字" * 60, "ab" * 200, "xyxxyx" * 50, "-=-=" * 60, "zzzzz" * 30]
    k = vocabulary.longest
    for text in texts:
        whole = op5.marked(text)
        for size in (1, 5, 16, 33, 64, 100):
            rows = [(whole[a : a + size + k - 1], len(whole[a : a + size])) for a in range(0, len(whole), size)]
            sums = op5.cut_sums(np.stack([vocabulary.matrix(*r) for r in rows])).tolist()
            cuts = op5.cut_states(np.array([vocabulary.entries(*r, v) for r, v in zip(rows, sums, strict=True)]))
            got = b"".join(vocabulary.trace_chunk(*r, v, cuts[i + 1]) for i, (r, v) in enumerate(zip(rows, sums, strict=True)))
            assert got == vocabulary.encode(whole), (text[:50], size)


def test_matrices_combine_associatively():
    rng = np.random.default_rng(0)
    mats = rng.integers(-50, 0, (9, 4, 4))
    total = mats[0]
    for k, prefix in enumerate(op5.scan(mats.astype(np.int64))):
        if k:
            total = (total[:, :, None] + mats[k][None]).max(axis=1)
        assert (prefix - prefix.max() == total - total.max()).all()


def test_sentencepiece_documents(spark, docs, odd, vocabulary):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for frame in (docs, odd):
        by_size = [Counter((r.doc_id, r.n_pieces, r.round_trip, r.ids_crc32) for r in op5.encode_documents(frame, path, chunk).collect()) for chunk in (1 << 16, 500, 64)]
        assert by_size[0] == by_size[1] == by_size[2] and sum(by_size[0].values()) == frame.count()
        assert all(k[2] for k in by_size[0])
    coded = op5.encode_documents(docs, path, 2000, with_ids=True)
    assert {r.doc_id: r.text for r in op5.decode_documents(coded, path).collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert op5.encode_documents(odd.filter("false"), path).count() == 0


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_near(rows):
    """(class, links) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc_id)
    return Counter((rows[i][0], least[find(i)], links[i]) for i in range(len(rows)))


def near_case():
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(0, 120, 2)]  # near each other
    rows += [(200 + i, " ".join(base)) for i in range(5)] + [(300, "short text"), (301, "Short, text!"), (302, "other words here")]
    return rows + [(400 + i, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(20)]


@pytest.mark.parametrize("block", [128, 7, 1])
def test_near_duplicates(spark, block):
    rows = near_case()
    got = op6.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_near(rows)


def test_near_duplicates_of_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = op6.op6_ngram_jaccard(spark, SF).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_near(rows)


def test_near_duplicate_edge_cases(spark, odd):
    rows = op6.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_links == 0 for r in rows if r.doc_id is None or not r.n_grams)
    assert op6.near_duplicates(odd.filter("false")).count() == 0


def test_bands_reach_the_recall():
    bands, rows = op6.band_plan()
    assert bands * rows <= op6.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= op6.RECALL


def brute_exact(rows):
    keep, size = {}, Counter()
    for doc_id, text in rows:
        size[text or ""] += 1
        if doc_id is not None:
            keep[text or ""] = max(keep.get(text or "", doc_id), doc_id)
    return Counter((d, keep.get(t or ""), size[t or ""], d == keep.get(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 8}, {"block_bytes": 16, "block_hash": lambda b: F.octet_length(b).cast("long")}])
def test_exact_groups(spark, docs, odd, options):
    """Also with small blocks (more levels) and a hash under which many blocks clash."""
    extra = [(1000, "abc"), (1001, "abc"), (1002, "abcabcabcabc"), (1003, "abcabcabcabc "), (1003, "abcabcabcabc "), (1004, None), (1005, "")]
    frame = docs.limit(40).select("doc_id", F.substring("text", 1, 300).alias("text")).unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    frame = spark.createDataFrame(frame.collect(), frame.schema)
    got = Counter(tuple(r) for r in op9.exact_groups(frame, **options).collect())
    assert got == brute_exact([(r.doc_id, r.text) for r in frame.collect()])


def test_exact_edge_cases(spark, odd):
    got = Counter(tuple(r) for r in op9.exact_groups(odd).collect())
    assert got == brute_exact([(r.doc_id, r.text) for r in odd.collect()])
    assert op9.exact_groups(odd.filter("false")).count() == 0
    kept = op9.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for t in ODD})


def test_pipeline(spark, docs):
    """Each stage on what the one before kept, with stages 7, 9 and 6 checked against plain Python."""
    from recordloom.llm.op7_quality import quality

    frame, columns = docs, docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "exact dedup", "n-gram Jaccard join", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in frame.collect()]
        path = new_path(spark, "stage")
        stage(spark, frame, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns
        kept = {r.doc_id for r in after.collect()}
        if name == "quality rules":
            want = {r.doc_id for r in quality(frame, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
        elif name == "language ID":
            learned = set(op10.profiles(frame))  # of so few documents, not every language
            want = {r.doc_id for r in frame.collect() if r.lang in learned and any(c.isalpha() for c in r.text or "")}
        elif name == "exact dedup":
            want = {d for d, k, _, _, _ in brute_exact(before) if d == k}
        else:
            want = {d for d, c, _ in brute_near(before) if d == c}
        assert kept == want and after.count() == len(want)
        frame = after
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in frame.collect()], op3.CAPACITY)


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    """Nulls, repeats, ties, a very long text, and columns named as the operators name theirs."""
    prose = " ".join(f"word{i % 97} and the river {i}" for i in range(60))
    texts = [None, "", "  ", prose, prose, prose.replace("river 7 ", "lake 7 "), "漢字 " * 40, "x" * 200_000, prose * 40]
    rows = [(i if i != 4 else 3, t, "en", "s", i, i, "a", "b", True, 1, "c") for i, t in enumerate(texts)] + [(None, prose, None, None, 9, 9, "a", "b", True, 1, "c")]
    names = "doc_id long, text string, lang string, source string, n_chars int, id int, sha string, kept_sha string, more boolean, kept_id int, `__sha` string"
    odd = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd, odd.filter("false")):
            out = stage(spark, frame, SF)
            got = out.collect()
            if name == "best-fit packing":
                assert len({(r.sequence_id, r.offset) for r in got}) == len(got) >= frame.count()
            else:
                assert out.columns == odd.columns and set(map(tuple, got)) <= set(rows)
    kept = [r.doc_id for r in corpus_pipeline.exact_dedup(spark, odd, SF).collect()]
    assert sorted(kept) == [1, 2, 3, 5, 6, 7, 8]
    near = [r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, SF).collect()]
    assert sorted(near, key=str) == sorted([0, 1, 2, 3, 3, 6, 7, None], key=str)
