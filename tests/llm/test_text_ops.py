"""Operators 1, 2, 7, 8 and 10 against plain Python, and their edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import op1_url as op1
from recordloom.llm import op2_toxicity as op2
from recordloom.llm import op7_quality as op7
from recordloom.llm import op8_license as op8
from recordloom.llm import op10_langid as op10
from recordloom.llm.queries import QUERIES, SQL
from recordloom.llm.textops import BLANKS, ngram_sets, span_hashes, utf8_slices, word_spans

SF = "/root/testdata/sf0.001"
#: Nulls, an empty text, blanks only, ties, a very long text, control characters, and columns whose names operators use too.
ODD = [None, "", "   \n\n ", "one", "one", "é" * 5000 + " word" * 40000, "a\x00b\x1fc\u2028d", "All rights reserved.\nALL RIGHTS RESERVED"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i % 5, t, None, None, 1, "x", True, "c") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, host string, kept boolean, token string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_words_match_regular_expressions(spark):
    sample = [t for t in ODD if t] + list(texts(spark).values())[:60]
    for row, end, data, offsets in utf8_slices(pa.array(sample), limit=3000):
        starts, ends, rows = word_spans(data, offsets, BLANKS)
        found = [(int(r), data[s:e].tobytes().decode()) for s, e, r in zip(starts, ends, rows, strict=True)]
        assert found == [(i, w) for i, t in enumerate(sample[row:end]) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        hashes = span_hashes(data, starts, ends)
        assert len(set(hashes.tolist())) == len({w for _, w in found})


def test_ngram_sets_have_the_sizes_of_sets():
    sample = ["a b c d e f a b c d e", "A, b.", "", "x y z w v", "a b c d e f a b c d e"]
    (_, _, data, offsets), = utf8_slices(pa.array(sample))
    grams, bounds = ngram_sets(data, offsets, 5)
    assert np.diff(bounds).tolist() == [6, 1, 0, 1, 6]
    assert grams[bounds[0] : bounds[1]].tolist() == grams[bounds[4] : bounds[5]].tolist()


def test_urls(spark):
    cases = {
        "http://WWW.Example.COM/en/x?y": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.example.com/en/1#t": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://a.example.com/de/1": ("a.example.com", "/de/1", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/esp": ("x.net", "/esp", None, "allow"),
        "http://notcom/": ("notcom", "/", None, "allow"),
        "http://com?q=/": ("com", "", None, "allow"),
        "www.example.com/en/": ("", "", None, "allow"),
        "a://b://c.com/": ("b:", "//c.com/", None, "allow"),
        "http://m.spam-farm.org/x": ("m.spam-farm.org", "/x", None, "block"),
        None: ("", "", None, "allow"),
        "http://É.com/\n/z": ("É.com", "/\n/z", "com/", "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    for inline in (1000, 0):  # rules inside the plan, and rules joined
        got = op1.judge_urls(pages, op1.SITE_RULES + op1.PATTERN_RULES, inline=inline).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == dict(enumerate(cases.values()))
    assert op1.judge_urls(pages.filter("false"), op1.SITE_RULES).count() == 0
    assert op1.judge_urls(pages, []).filter("verdict = 'allow'").count() == len(cases)


def test_rules_are_indexed_by_their_rarest_literal():
    rule = op1.Rule("r", "block", "x", ("common", "rare"))
    assert op1.index_token(rule, {"common": 9, "rare": 1}) == "rare"
    assert op1.site_rule("block", "a.org", "/en").literals == ("a", "org")  # /english matches too


def test_url_query_equals_its_sql(spark):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(connection.execute(f"select page_id, host, path, rule, verdict from ({SQL['op1_url_filters']})").fetchall())
    got = QUERIES["op1_url_filters"](spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == want


def test_grammar_weighs_clauses():
    grammar = op2.Grammar({"idiot": 5.0, "clown": 5.0})
    plain, negated, reported = (grammar.score(t) for t in ("You idiot, what a clown.", "You are not an idiot.", "They said idiot."))
    assert plain > 0.9 > negated and plain > reported
    assert grammar.score("") == grammar.score("A quiet day.") == pytest.approx(op2.NO_MATCH)
    assert grammar.clause_weight(["we", "will", "strangle", "you"])[0] > -1


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    found = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert found / sum(r.predicted for r in rows) > 0.85
    assert found / sum(labels[r.doc_id] for r in rows) > 0.85


def test_toxicity_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert op2.learn_insults(odd, labels) == {}
    assert op2.score_texts(odd, {"one": 3.0}).count() == len(ODD)
    assert op2.score_texts(empty, {}).count() == 0


def test_toxicity_scores_equal_those_of_the_grammar(spark):
    insults = {"idiota": 5.0, "idiot": 5.0, "l'idiot": 5.0, "bête": 5.0, "дурак": 5.0, "diot": 5.0, "öäü": 5.0}
    cases = ["¡Idiota!", "“idiot”", "«idiot»", "an\u2014idiot\u2026", "un\u00a0idiot", "L'idiot, l\u2019idiot", "BÊTE", "ДУРАК!", "İdiot", "ÖÄÜ", "You_kill_them",
             "\u201cStrangle\u201d you", "idiots", "\u212aill you", "étrangler\u00a0toi", "x" * 300_000 + "\u00b7idiot"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for some in (insults, {w: v for w, v in insults.items() if w.isascii()}):
        grammar = op2.Grammar(some)
        got = {cases[r.doc_id]: r.score for r in op2.score_texts(docs, some).collect()}
        assert got == pytest.approx({t: grammar.score(t) for t in cases})
        assert got["¡Idiota!"] > op2.NO_MATCH < got["«idiot»"]


def test_negated_and_reported_threats_are_not_toxic(spark, tmp_path):
    cases = {"She said it did not hurt him": 0, "I will never hurt you": 0, "They said they destroy them": 0, "I will hurt you": 1, "Ich werde dich schlagen": 1,
             "I will never hurt you. They said she would kill him. " * 20: 0}
    texts = [*cases, *(f"The storm may hurt them, day {i}" for i in range(80))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(len(cases), len(texts))]
    for seen, plain in ((labels[:0], 1), ([(i, q, i % 2) for i, q, _ in labels], 1), (labels, 0)):
        spark.createDataFrame(seen, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        got = {texts[r.doc_id]: r.predicted for r in QUERIES["op2_toxicity"](spark, str(tmp_path)).collect()}
        assert {t: got[t] for t in cases} == {t: p * plain for t, p in cases.items()}


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(covered)


def test_quality_counts(spark):
    for r in QUERIES["op7_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_separates_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.1").filter("not base_failed").join(labels, "doc_id")
    kept = rows.selectExpr("quality", "cast(kept as int) as kept").groupBy("quality").agg(F.avg("kept").alias("share"))
    shares = {r.quality: r.share for r in kept.collect()}
    assert shares[1] > 0.99 and shares.get(0, 0) < 0.2


def test_quality_edge_cases(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("false")):
        rows = op7.quality(odd, some).collect()
        assert len(rows) == len(ODD) and Counter(r.n_words for r in rows)[0] == 3
    assert op7.quality(empty, labels).count() == 0


def brute_license(text, notices):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words, places, base = find(lowered), [], set()
    for phrase, label in op8.PHRASES.items():
        own = phrase.split()
        for k in range(len(words) - len(own) + 1):
            if words[k : k + len(own)] == own:
                places.append(k)
                base.add(label)
    labels, score = set(base), 0.0
    for line in lowered.split("\n"):
        block = set(find(line))
        held = {k: (len(block & t) / len(t), len(block & t)) for k, t in notices.items() if len(block & t) >= 0.8 * len(t) - 1e-9}
        if held:
            best = max(held.values())
            score = max(score, best[0])
            labels |= {k for k, v in held.items() if v == best}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else score


def test_license_scan(spark, odd, empty):
    find = re.compile(r"[a-z0-9]+").findall
    notices = {k: set(find(v.lower())) for k, v in op8.NOTICES.items()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + i, t) for i, t in enumerate([*op8.NOTICES.values(), "cc\nby, CC.BY", "Licensed under the Apache License Version", "mit license released\nunder the"])]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    want = {r.doc_id: brute_license(r.text, notices) for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op8.notice_matches(docs).collect()}
    assert {k: (*v[:6], round(v[6], 9)) for k, v in got.items()} == {k: (*v[:6], round(v[6], 9)) for k, v in want.items()}
    rows = op8.notice_matches(odd).collect()
    assert len(rows) == len(ODD) and max(r.n_base for r in rows) == 2
    assert op8.notice_matches(empty).count() == 0


def license_labels(spark, cases):
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    return {cases[r.doc_id]: (r.labels, round(r.score, 9)) for r in op8.notice_matches(docs).collect()}


def test_every_notice_of_a_line_is_labelled(spark):
    gpl, lgpl, apache = (op8.NOTICES[k] for k in ("gpl-3.0", "lgpl-3.0", "apache-2.0"))
    cases = {
        f"Released under the MIT License or {apache}": "apache-2.0,mit",
        f"{apache} or the MIT License": "apache-2.0,mit",
        f"{gpl} or GNU Lesser General Public License, version 3": "gpl,gpl-3.0,lgpl-3.0",
        f"{lgpl} or GNU General Public License, version 3": "gpl,gpl-3.0,lgpl-3.0",
        lgpl: "gpl,lgpl-3.0",
        gpl: "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0 by the author": "cc-by,cc-by-nc-4.0",
        " ".join(op8.NOTICES.values()): ",".join(sorted({"cc-by", "gpl", *op8.NOTICES})),
    }
    assert license_labels(spark, list(cases)) == {text: (labels, 1.0) for text, labels in cases.items()}


def test_notices_run_over_line_breaks_and_stand_close(spark):
    prose = " ".join(["a river and a bridge"] * 300)
    cases = {n.replace(" ", "\n", 1).replace(" with", "\n   with").replace(" of", "\n# of"): k for k, n in op8.NOTICES.items() if k in ("bsd", "mpl-2.0", "mit")}
    cases["This work is licensed under the\n * GNU Lesser General Public\n * License, version 3"] = "gpl,lgpl-3.0"
    cases["Released under the MIT\nLicense or licensed under\r\nthe Apache License,\n\nVersion 2.0"] = "apache-2.0,mit"
    got = license_labels(spark, [*cases, f"Released under {prose} the MIT {prose} License", f"MIT {prose} license {prose}\nreleased under"])
    assert got == {t: (labels, 1.0) for t, labels in cases.items()} | {t: ("", 0.0) for t in got if prose in t}


def test_language_id(spark, odd, empty):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    known = op10.profiles(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    judged = op10.identify(odd, known).collect()
    assert len(judged) == len(ODD) and sum(r.lang_pred == op10.UNKNOWN for r in judged) == 3
    assert op10.profiles(odd) == {} and {r.lang_pred for r in op10.identify(odd, {}).collect()} == {op10.UNKNOWN}
    assert op10.identify(empty, known).count() == 0 and op10.profiles(empty) == {}


def test_rank_order_distance():
    (_, _, data, offsets), = utf8_slices(pa.array(["ab ab", "zz"]))
    rows, grams, counts = op10.ngrams(data, offsets)
    first = {g: c for r, g, c in zip(rows, grams, counts, strict=True) if r == 0}
    code = lambda s: sum(ord(c) << 8 * i for i, c in enumerate(s))
    assert first == {code(s): 2 for s in ("a", "b", "ab", " a", "b ", " ab", "ab ")}


def test_language_distance_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = op10.profiles(docs)
    sample = [t for t in texts(spark).values()][:40] + ["Ab, ab!", "ñandú ÑANDÚ", "x", "word " * 50_000, "漢字", "1 2 3"]

    def profile(text):
        held = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
        held = b"  " + held + b"  "
        counts = Counter(b for b in held if b != 32)
        counts.update(a | b << 8 for a, b in zip(held, held[1:]) if a != 32 or b != 32)
        counts.update(a | b << 8 | c << 16 for a, b, c in zip(held, held[1:], held[2:]) if b != 32)
        return [g for g, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))][: op10.PROFILE]

    langs, known, places = op10._table(found)
    (_, _, data, offsets), = utf8_slices(pa.array([t.lower() for t in sample]), limit=1 << 30)
    got = op10.distances(data, offsets, known, places)
    for row, text in enumerate(sample):
        own = profile(text)
        for k, lang in enumerate(langs):
            rank = {g: r for r, g in enumerate(found[lang].tolist())}
            want = sum(abs(rank[g] - r) if g in rank else op10.PROFILE for r, g in enumerate(own)) / max(len(own), 1)
            assert got[row, k] == pytest.approx(want), (text[:40], lang)


def test_language_stage_drops_what_was_never_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op10.profiles(docs)
    limit = op10.farthest(docs, found)
    odd = ["漢字 仮名 文字 " * 30, "привет как дела мир " * 20, "xq zzkw pfft " * 40, "12 34", "", None]
    more = spark.createDataFrame([(-1 - i, t, "en", "x", 1) for i, t in enumerate(odd)], docs.schema)
    kept = {r.doc_id for r in op10.kept_documents(docs.unionAll(more), found, limit).collect()}
    assert min(kept) >= 0 and len(kept) > 0.99 * docs.filter("lang is not null").count()
    some = op10.kept_documents(docs, found, limit, ["fr"])
    assert some.count() and some.filter("lang <> 'fr'").count() < 0.02 * some.count()
    assert op10.kept_documents(docs, {}, 300.0).count() == 0 and op10.farthest(docs.filter("false"), {}) == op10.PROFILE


def plain_clause(words, insults, threat):
    """The grammar's rules written out as conditions."""
    since, reported, targeted, own, most = op2.NEGATION_REACH, False, False, [], 0.0
    for word in words:
        if word in op2.NEGATIONS:
            since = 0
            continue
        reported, targeted = reported or word in op2.REPORTS, targeted or word in op2.TARGETS
        factor = (op2.NEGATED if since < op2.NEGATION_REACH else 1.0) * (op2.REPORTED if reported else 1.0)
        most = max(most, factor) if word in op2.THREATS else most
        own += [insults[word] * factor] if word in insults else []
        since += 1
    if not own:
        return (threat, 0) if most == 1 and targeted else None
    return max(own) + op2.FURTHER * min(sum(own) - max(own), 4.0) + op2.TARGETED * targeted + op2.THREATENED * most, len(own)


def test_composed_transducers_follow_the_rules():
    rng = np.random.default_rng(5)
    insults = {"idiot": 5.0, "clown": 2.5, "said": 1.0, "kill": 3.0}
    words = ["idiot", "clown", "kill", "hurt", "not", "never", "said", "claimed", "you", "him", "a", "river"]
    grammar = op2.Grammar(insults, 1.25)
    for n in [0, 1, *rng.integers(1, 12, 3000)]:
        clause = [words[i] for i in rng.integers(0, len(words), n)]
        assert grammar.clause_weight(clause) == pytest.approx(plain_clause(clause, insults, 1.25)), clause


def test_quality_verdicts_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}

    def buckets(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if not words:
            return []
        hashes = op7.span_hashes(*(lambda d, e: (d, np.concatenate([[0], e[:-1] + 1]), e))(np.frombuffer("\n".join(words).encode(), dtype=np.uint8), np.cumsum([len(w.encode()) + 1 for w in words]) - 1))
        pairs = [op7.ngram_hashes(hashes[i : i + 2], np.zeros(2, dtype=np.int64), 2)[0][0] for i in range(len(words) - 1)]
        return [int(h) >> 48 for h in [*hashes, *pairs]]

    own = {r.doc_id: buckets(r.text) for r in docs.collect()}
    raw, good = Counter(), Counter()
    for doc_id, some in own.items():
        raw.update(some)
        good.update(some if doc_id in trusted else [])
    n_raw, n_good, half = sum(raw.values()), sum(good.values()), 0.5 * op7.BUCKETS
    ratio = {b: np.log((good[b] + 0.5) / (n_good + half)) - np.log((raw[b] + 0.5) / (n_raw + half)) for b in raw}
    score = {d: sum(ratio[b] for b in some) / max(len(some), 1) for d, some in own.items()}
    fair = {d: score[d] + op7.SLACK / max(len(own[d]), 1) ** 0.5 for d in own}
    rows = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    least = np.percentile([fair[d] for d in own if d in trusted and not rows[d].base_failed], 100 * op7.TRUSTED_LOSS)
    for doc_id, r in rows.items():
        assert r.score == pytest.approx(score[doc_id])
        if abs(fair[doc_id] - least) > 1e-9:
            assert r.kept == (not r.base_failed and fair[doc_id] > least)


def test_url_edge_cases(spark):
    rows = [(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, "http://a.net/es/"), (None, None), (2, "http://x.com/" + "a" * 300_000), (3, "://"), (4, "")]
    pages = spark.createDataFrame([(i, u, "clash", "r", None, 1) for i, u in rows], "page_id long, url string, host string, rule string, verdict string, token int")
    got = op1.judge_urls(pages, op1.SITE_RULES + op1.PATTERN_RULES).select("page_id", "host", "rule", "verdict").collect()
    want = [(1, "a.net", "net/es/", "block")] * 2 + [(None, "a.net", "net/es/", "block"), (None, "", None, "allow"), (2, "x.com", "com/", "allow"), (3, "", None, "allow"), (4, "", None, "allow")]
    assert Counter(map(tuple, got)) == Counter(want)


def brute_texts(text):
    """Labels of the license texts that some window of the text holds to the threshold, nested ones included."""
    find = re.compile(r"[a-z0-9]+").findall
    words, out = find(text.lower()), set()
    for name, whole in op8.TEXTS.items():
        own = find(whole.lower())
        if len(own) > op8.SENTENCE:
            reach, tokens = int(np.ceil(op8.TEXT_REACH * len(own))), set(own)
            if any(len(tokens & set(words[i : i + reach])) >= 0.8 * len(tokens) - 1e-9 for i in range(max(1, len(words) - reach + 1))):
                out.add(name.split("/")[0])
    return out


def test_whole_license_texts(spark):
    rng = np.random.default_rng(1)
    prose = " ".join(["the copy of a river and the use of this bridge"] * 60)
    cases, texts_of = [], list(op8.TEXTS.items())
    for name, text in texts_of:
        words = text.split()
        cases += [f"{prose}\n{text}\n{prose}", "\n\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))]
        cases.append(" ".join(w for w in words if rng.random() > 0.1))
        cases.append(" ".join(words[: len(words) // 2]) + prose * 9 + " ".join(words[len(words) // 2 :]))  # torn apart
    cases.append(prose.join(t for _, t in texts_of))
    got = license_labels(spark, cases)
    whole = {name.split("/")[0] for name in op8.TEXTS}
    for case in cases:
        found = {x for x in got[case][0].split(",") if x in whole}
        brute = brute_texts(case)
        sentences = {"apache-2.0", "bsd", "mpl-2.0", "gpl-3.0", "lgpl-3.0"}  # notices of one sentence have these labels too
        assert found - sentences <= brute, case[:80]
        assert brute - found <= {"gpl-3.0", "lgpl-3.0"} and (not brute or found), case[:80]  # one nests in the other
    for k, (name, _) in enumerate(texts_of):
        label = name.split("/")[0]
        assert all(label in got[cases[4 * k + i]][0].split(",") for i in (0, 1)), name
    assert set(got[cases[-1]][0].split(",")) >= whole
