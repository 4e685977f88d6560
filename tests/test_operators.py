"""Duplicates, plans, similarity, reuse, journal, reports, sources and streams on small tables."""

import os
import random
import struct
import zlib
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordloom.functions.filters import ScanFilter
from recordloom.functions.fingerprints import hamming_distance, image_fingerprints, sha256
from recordloom.operators import commit, dedupe, journal, levels, plan, report, reuse, similar
from recordloom.operators.components import connected_components
from recordloom.operators.narrow import narrowed
from recordloom.operators.storage import materialize, new_path
from recordloom.plans.run import Cancelled, RunOptions, apply, preview, read_issues, read_records, recover, undo, undo_last
from recordloom.sources.files import file_digests, file_signatures, inventory_from_files, snapshot_of_files
from recordloom.sources.inventory import inventory_from_table, rejected_rows, scan_summary
from recordloom.sources.synthetic import synthetic_inventory
from recordloom.streaming.intake import incremental_intake, read_intake

DAY = 86400


def table(spark, rows):
    """rows: (path, content) or (path, content, day)."""
    rows = [(p, c, datetime.fromtimestamp(1_700_000_000 + DAY * (more[0] if more else 0), tz=timezone.utc)) for p, c, *more in rows]
    frame = spark.createDataFrame(rows, "path string, body string, time timestamp")
    return inventory_from_table(frame, F.col("path"), F.col("body"), F.col("time"))


def test_same_size_is_not_same_content(spark):
    rows = table(spark, [("/a", "same-content"), ("/b", "same-content"), ("/c", "same-contenu"), ("/d", "unique"), ("/e", ""), ("/f", "")])
    members = {(r.full_path, r.group_size, r.group_rank) for r in dedupe.duplicate_members(rows).collect()}
    assert members == {("/a", 2, 1), ("/b", 2, 2), ("/e", 2, 1), ("/f", 2, 2)}
    assert {r.full_path for r in dedupe.byte_verified(rows).collect()} == {"/a", "/b", "/e", "/f"}


@pytest.mark.parametrize("n", [2, 3, 41])
def test_copies_are_one_group(spark, n):
    rows = table(spark, [(f"/x{i:02d}", "x" * 1024) for i in range(n)] + [("/y", "y" * 1024)])
    assert dedupe.dedupe_summary(dedupe.duplicate_members(rows)).first() == (1, n - 1, 1024 * (n - 1))
    (group,) = dedupe.duplicate_groups(rows).collect()
    assert [f.full_path for f in group.files] == [f"/x{i:02d}" for i in range(n)]


def test_no_rows(spark):
    rows = table(spark, [("/a", "x")]).filter("false")
    assert dedupe.dedupe_summary(dedupe.duplicate_members(rows)).first() == (0, 0, 0)
    assert scan_summary(rows).first() == (0, 0)
    assert plan.organize_plan(rows, "copy", "/t").count() == 0


def test_keepers_and_protection(spark):
    members = dedupe.duplicate_members(table(spark, [("/b", "x", 1), ("/a", "x", 2), ("/c", "x", 1), ("/u", "u"), ("/v", "u")]))
    assert {r.full_path for r in plan.keepers(members).filter("keep").collect()} == {"/b", "/u"}
    marks = spark.createDataFrame([("/a",), ("/c",), ("/nowhere",)], "full_path string")
    assert {r.full_path for r in plan.keepers(members, marks).filter("keep").collect()} == {"/a", "/c", "/u"}


def destinations(actions):
    return {r.source_path: r.destination_path for r in actions.collect()}


def test_names_are_numbered(spark):
    rows = table(spark, [("/one/report.txt", "a", 0), ("/two/report.txt", "b", 1)])
    got = destinations(plan.organize_plan(rows, "copy", "/t"))
    assert got == {"/one/report.txt": "/t/Documents/2023/11/report.txt", "/two/report.txt": "/t/Documents/2023/11/report (1).txt"}


def test_numbers_avoid_names_that_exist(spark):
    rows = table(spark, [("/1/a.txt", "a", 0), ("/2/a (1).txt", "b", 0.1), ("/3/a.txt", "c", 0.2), ("/4/a.txt", "d", 0.3), ("/5/b.txt", "e", 0.4)])
    there = spark.createDataFrame([("/t/Documents/2023/11/b.txt",), ("/t/Documents/2023/11/a (2).txt",)], "full_path string")
    names = {k: v.rsplit("/", 1)[1] for k, v in destinations(plan.organize_plan(rows, "move", "/t", existing=there)).items()}
    assert names == {"/1/a.txt": "a.txt", "/2/a (1).txt": "a (1).txt", "/3/a.txt": "a (3).txt", "/4/a.txt": "a (4).txt", "/5/b.txt": "b (1).txt"}


def test_plan_is_numbered_in_order(spark):
    rows = table(spark, [(f"/d/{i:03d}.txt", str(i), i % 7) for i in range(60)])
    seqs = [(r.seq, r.source_path) for r in plan.organize_plan(rows, "copy", "/t").collect()]
    assert [p for _, p in sorted(seqs)] == [f"/d/{i:03d}.txt" for i in sorted(range(60), key=lambda i: (i % 7, i))]
    assert sorted(s for s, _ in seqs) == list(range(1, 61))


def test_wrong_modes_are_refused(spark):
    rows = table(spark, [("/a", "x")])
    for call in (lambda: plan.organize_plan(rows, "link", "/t"), lambda: plan.dedupe_plan(rows, "burn", "/"), lambda: preview(rows, RunOptions("/", "/t", "nothing"))):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("scope", list(plan.SCOPES))
@pytest.mark.parametrize("mode", plan.DEDUPE_MODES)
def test_scopes(spark, scope, mode):
    rows = table(spark, [("/s/a", "dup"), ("/s/b", "dup"), ("/s/c", "x"), ("/s/.h", "dup")])
    result = preview(rows, RunOptions("/s", "/t", scope, dedupe_mode=mode))
    assert result.summary.first()["total_files_scanned"] == 3
    removed = scope != "group_only" and mode != "off"
    assert (result.removed.count() if result.removed is not None else None) == (None if scope == "group_only" else int(removed))
    assert (result.to_organize.count() if result.to_organize is not None else None) == (None if scope == "dedupe_only" else 3 - removed)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(63)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (500, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(64)} | {100 + i: 100 for i in range(50)} | {500: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_records(spark):
    base = 0x0123456789ABCDEF
    prints = {"/a": base, "/b": base ^ 0b111, "/c": base ^ 0b111 ^ (0b111 << 20), "/d": base, "/far": ~base, "/z": 1}
    frame = spark.createDataFrame([(p, h if h < 1 << 63 else h - (1 << 64)) for p, h in prints.items()], "full_path string, h long")
    clusters = similar.similar_clusters(frame, 3)
    assert {r.full_path for r in clusters.collect()} == {"/a", "/b", "/c", "/d"}
    times = table(spark, [(p, p, i) for i, p in enumerate(sorted(prints, reverse=True))])
    (group,) = similar.similar_groups(frame, times, 3).collect()
    assert group.anchor_path == "/d" and group.similar_paths == ["/c", "/b", "/a"]
    pairs = {(r.a, r.b): r.distance for r in similar.similar_pairs(frame, 3).collect()}
    assert pairs == {("/a", "/b"): 3, ("/b", "/c"): 3}
    assert {r.full_path: r.representative for r in similar.similar_membership(frame).collect()} == {p: "/a" if p == "/d" else p for p in prints}
    with pytest.raises(ValueError):
        similar.similar_clusters(frame, 3, max_pairs=1)


def test_large_buckets_are_split(spark):
    # one shared first band; the next one has two values, and the others differ
    rows = [(f"/{i}", 7 | (i % 2) << 16 | (i + 1) << 32 | (i + 1) << 48) for i in range(12)]
    frame = spark.createDataFrame(rows, "full_path string, h long")
    assert similar.candidate_fingerprints(frame, limit=100).count() == 66
    split = similar.candidate_fingerprints(frame, limit=5).collect()
    assert len(split) == 30 and not any((r.ha ^ r.hb) >> 16 & 1 for r in split)


@pytest.mark.parametrize(("distance", "equal"), [(0, 1), (1, 1), (3, 2), (8, 1), (8, 2), (8, 3), (8, 4), (8, None), (20, 1)])
def test_exact_pairs_are_all_pairs(spark, distance, equal):
    """Every pair within the distance, once, whatever the number of equal blocks; hot buckets and the sign bit included."""
    rng = random.Random(distance)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        near = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(0, 12)):
            near ^= 1 << bit
        prints.append(near)
    prints += [(1 << 64) - 1, (1 << 63), 0, 1, 0]
    signed = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in prints})
    want = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance)
    frame = spark.createDataFrame([(str(i), v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(prints)], "full_path string, h long")
    for block in (16, similar.BLOCK):
        assert sorted(map(tuple, similar.exact_fingerprints(frame, distance, equal, block).collect())) == want


def test_more_fingerprints_take_more_equal_blocks():
    chosen = [similar.block_count(n, 8) for n in (10, 10**4, 10**6, 10**8, 10**10)]
    assert chosen == sorted(chosen) and chosen[0] == 1 and chosen[-1] == similar.MAX_EQUAL


def test_large_buckets_lose_no_pair(spark):
    rows = [(f"/{i}", 7 | (i % 2) << 16 | (i + 1) << 32 | (i + 1) << 48) for i in range(12)]
    frame = spark.createDataFrame(rows, "full_path string, h long")
    for block in (100, 5, 1):
        assert similar.candidate_fingerprints(frame, block=block).count() == 66
    copies = spark.range(2049).selectExpr("concat('/', id) as full_path", "cast(1234567 as long) as h")
    near = spark.createDataFrame([("/near", 1234567 ^ 1 << 16 ^ 1 << 48)], "full_path string, h long")
    clusters = similar.similar_clusters(copies.union(near), 3)
    assert clusters.count() == 2050 and clusters.select("cluster").distinct().count() == 1


def png(path, pixels):
    """A grayscale picture."""
    height, width = len(pixels), len(pixels[0])

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_image_fingerprints(spark, tmp_path):
    ramp = [[255 - 3 * x for x in range(72)] for _ in range(64)]
    png(tmp_path / "a.png", ramp)
    png(tmp_path / "twice.png", [[v for v in row for _ in (0, 1)] for row in ramp for _ in (0, 1)])
    png(tmp_path / "inverted.png", [[255 - v for v in row] for row in ramp])
    found = {r.full_path.rsplit("/", 1)[1]: r.h for r in image_fingerprints(spark.read.format("image").load(str(tmp_path))).collect()}
    assert found["a.png"] == found["twice.png"]
    frame = spark.createDataFrame([(found["a.png"], found["inverted.png"])], "a long, b long")
    assert frame.select(hamming_distance(F.col("a"), F.col("b"))).first()[0] == 64


def test_fingerprints_are_reused(spark):
    folder = new_path(spark, "store")
    assert reuse.read_fingerprints(spark, folder).count() == 0
    rows = table(spark, [("/a", "x", 1), ("/b", "y", 1)])
    first = reuse.with_fingerprints(rows, reuse.read_fingerprints(spark, folder), sha256)
    reuse.write_fingerprints(reuse.fingerprint_upsert(reuse.read_fingerprints(spark, folder), first, F.current_timestamp()), folder, 1)
    changed = table(spark, [("/a", "longer", 2), ("/b", "y", 1)])
    store = reuse.read_fingerprints(spark, folder)
    assert reuse.fingerprint_stats(changed, store).first() == (1, 1, 1, 0, 2)
    second = reuse.with_fingerprints(changed, store, sha256)
    assert {r.full_path: r.reused for r in second.collect()} == {"/a": False, "/b": True}
    reuse.write_fingerprints(reuse.fingerprint_upsert(store, second, F.current_timestamp()), folder, 2)
    store = reuse.read_fingerprints(spark, folder)
    assert store.count() == 2 and store.filter("full_path = '/a'").first().size_bytes == 6
    assert reuse.fingerprint_hits(changed, store, refresh=True).count() == 0
    assert reuse.retain(store, 1).count() == 1 and reuse.retain(store, 0).count() == 2


def entry(tx, seq, event, action, status, destination="/t/x"):
    return tx, seq, event, action, f"/s/{seq}", destination, datetime(2024, 1, 1), status, None, action != "deleted_duplicate"


def heads(spark, rows):
    return spark.createDataFrame([(t, datetime(2024, 1, 1), "/s", "/t", s, "x", 0, 0, None, datetime(2024, 1, 1 + i), None) for i, (t, s) in enumerate(rows)], journal.TRANSACTIONS)


def test_undo_of_each_action(spark):
    kinds = ["moved", "copied", "quarantined_duplicate", "moved", "deleted_duplicate"]
    rows = [entry("t", i, 0, k, "pending") for i, k in enumerate(kinds)] + [entry("t", i, 1, k, "done") for i, k in enumerate(kinds) if i != 3]
    entries = spark.createDataFrame(rows, journal.ENTRIES)
    undone = journal.undo_plan(entries)
    assert [r.seq for r in undone.orderBy("step").collect()] == [4, 2, 1, 0]
    summary = journal.undo_summary(undone).first()
    assert tuple(summary) == (1, 1, 1, 1)
    assert [r.error for r in undone.filter("error is not null").collect()] == ["Deleted record cannot be restored (/s/4)."]
    there = spark.createDataFrame([("/t/x",)], "full_path string")
    assert journal.undo_plan(entries, locations=there.filter("false")).count() == 1


def test_recovery(spark):
    entries = spark.createDataFrame([entry("a", 1, 1, "moved", "done"), entry("a", 2, 0, "moved", "pending"), entry("b", 1, 1, "copied", "done"), entry("c", 1, 1, "copied", "failed"), entry("d", 1, 0, "copied", "pending")], journal.ENTRIES)
    states = heads(spark, [("a", "running"), ("b", "completed"), ("c", "completed"), ("d", "rolled_back"), ("e", "cancelled")])
    assert [r.transaction_id for r in journal.recoverable_transactions(states, entries).collect()] == ["e", "c", "a"]
    assert journal.recovery_summary(journal.recover_all(states, entries)).first() == (0, 1, 0, 0)
    assert journal.latest_transaction(states).first().transaction_id == "e"


def test_rollback_issues(spark):
    entries = spark.createDataFrame([entry("t", 1, 1, "moved", "done", "/t/1"), entry("t", 2, 1, "copied", "done", "/t/2"), entry("t", 3, 0, "moved", "pending")], journal.ENTRIES)
    there = spark.createDataFrame([("/t/2",)], "full_path string")
    assert journal.verify_rollback(entries, there).count() == 2


def test_json_journals(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"transaction_id": "a", "source_root": "/s", "target_root": "/t", "entries": [{"action": "moved", "source_path": "/s/1", "destination_path": "/t/1"}]}')
    (tmp_path / "broken.json").write_text("{nonsense")
    states, entries = journal.read_json_journal(spark, str(tmp_path))
    assert [(r.transaction_id, r.lifecycle_status, r.checkpoint_stage) for r in states.collect()] == [("a", "completed", "legacy")]
    assert [(r.seq, r.status, r.reversible) for r in entries.collect()] == [(1, "done", True)]


def test_preview_apply_undo(spark):
    folder = new_path(spark, "run")
    rows = table(spark, [("/s/a.txt", "dup"), ("/s/b.txt", "dup"), ("/s/c.jpg", "solo")])
    options = RunOptions("/s", "/t")
    assert apply(rows, options, folder, "tx1").first() == (2, 0, 1, 0, 0, 0)
    organized = read_records(spark, folder, "organized")
    assert {(r.folder, r.year, r.month, r.name) for r in organized.select("folder", F.col("year").cast("string").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month"), "name").collect()} == {("Documents", "2023", "11", "a.txt"), ("Images", "2023", "11", "c.jpg")}
    assert read_records(spark, folder, "quarantine").first().content == "dup"
    entries, states = journal.read_table(spark, folder, "journal_entries"), journal.read_table(spark, folder, "transactions")
    assert journal.recoverable_transactions(states, entries).count() == 0
    assert journal.live_set(rows, entries, states).count() == 2
    counters, errors = undo_last(spark, folder, rows)
    assert tuple(counters.first()) == (2, 0, 1, 0) and errors.count() == 0
    states = journal.read_table(spark, folder, "transactions")
    assert journal.live_set(rows, journal.read_table(spark, folder, "journal_entries"), states).count() == 3
    assert journal.current_transactions(states).first().lifecycle_status == "rolled_back"
    with pytest.raises(ValueError):
        undo_last(spark, new_path(spark, "none"))


def test_reports(spark, tmp_path):
    rows = table(spark, [("/s/a", "dup"), ("/s/b", "dup"), ("/s/c", "x")])
    members = dedupe.duplicate_members(rows)
    summary = report.run_summary([scan_summary(rows), dedupe.dedupe_summary(members), plan.action_summary(plan.dedupe_plan(members, "delete", "/s"))], "now", "/s", "/t")
    metrics = {r.metric: r.value for r in report.report_metrics(summary).collect()}
    assert len(metrics) == 16 and metrics["DuplicateFiles"] == "1" and metrics["DuplicatesDeleted"] == "1"
    near = spark.createDataFrame([("/s/a", "/s/a", 2), ("/s/a", "/s/b", 2)], "anchor_path string, full_path string, group_size long")
    gone = spark.createDataFrame([("/s/gone, with a comma",)], "full_path string")
    wrong = spark.createDataFrame([('said "no"',)], "message string")
    report.write_report(str(tmp_path / "r"), summary, members, near, gone, wrong)
    assert spark.read.csv(str(tmp_path / "r/skipped"), header=True).first()[0] == "/s/gone, with a comma"
    assert spark.read.csv(str(tmp_path / "r/errors"), header=True, escape='"').first()[0] == 'said "no"'
    lines = [r.value for r in spark.read.text(str(tmp_path / "r/digest")).collect()]
    assert lines[0] == "Run Report" and lines[-1] == "- /s/a (+1 similar)" and any("(2 files, 3 B)" in x for x in lines)
    assert spark.read.json(str(tmp_path / "r/document")).first().summary.duplicate_group_count == 1
    assert spark.read.json(str(tmp_path / "r/duplicate_groups")).count() == 2
    assert "Similar Image Groups: 0" in lines and "Similar Image Groups:" in lines


def test_file_listing(spark, tmp_path):
    for name in ("a/b/c/deep.txt", "a/.hidden", "_under", "zero.bin", ".recordloom/no", "a/Duplicates_Quarantine/no"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "zero.bin" else name)
    os.symlink(tmp_path / "_under", tmp_path / "link")
    os.symlink(tmp_path / "gone", tmp_path / "broken")
    os.utime(tmp_path / "_under", ns=(0, 1_700_000_000_123_456_789))
    rows = inventory_from_files(spark, f"file://{tmp_path}")
    found = {r.full_path.removeprefix(f"{tmp_path}/"): r for r in rows.collect()}
    assert set(found) == {"a/b/c/deep.txt", "a/.hidden", "_under", "zero.bin"}
    assert found["_under"].last_write_utc.microsecond == 123456 and found["zero.bin"].size_bytes == 0
    assert {r.reject_reason for r in rejected_rows(rows, ScanFilter()).collect()} == {"hidden"}
    root = f"file://{tmp_path}"
    assert file_digests(rows, root).filter("sha256_hash is not null and read_error is null").count() == 4
    (tmp_path / "_under").unlink()
    for read in (file_digests, file_signatures):
        assert [r.full_path for r in read(rows, root).filter("read_error is not null").collect()] == []  # listed anew: it is gone
    gone = spark.createDataFrame([(f"{tmp_path}/_under", 6)], "full_path string, size_bytes long")
    assert file_digests(gone, root).first().read_error and file_signatures(gone, root).first().read_error
    failed = inventory_from_files(spark, f"file://{tmp_path}/missing").collect()
    assert len(failed) == 1 and failed[0].error


def test_synthetic_counts(spark):
    for n, dup, same in ((100, 0.2, 0.1), (101, 0.5, 0.5), (7, 0.0, 0.0)):
        rows = synthetic_inventory(spark, n, dup, same)
        assert rows.count() == n and rows.filter(F.octet_length("content") != F.col("size_bytes")).count() == 0
        assert dedupe.dedupe_summary(dedupe.duplicate_members(rows)).first()["duplicate_files_found"] == int(n * dup) // 2
    for wrong in ((0, 0.1, 0.1), (5, 0.8, 0.3), (5, -1, 0)):
        with pytest.raises(ValueError):
            synthetic_inventory(spark, *wrong)


def test_intake_over_batches(spark):
    folder = new_path(spark, "intake")

    def feed(rows):
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(table(spark, [("/", "")]).schema).parquet(f"{folder}/in")
        incremental_intake(stream, f"{folder}/store", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    feed([("/a", "x", 1), ("/b", "x", 0), ("/c", "y", 0)])
    feed([("/d", "y", 0), ("/e", "new", 0), ("/c", "y", 0)])
    rows = {(r.batch, r.full_path): (r.is_duplicate, r.reused) for r in read_intake(spark, f"{folder}/out").collect()}
    assert rows == {(0, "/a"): (True, False), (0, "/b"): (False, False), (0, "/c"): (False, False), (1, "/d"): (True, False), (1, "/e"): (False, False), (1, "/c"): (False, True)}


def test_duplicate_files(spark, tmp_path):
    mib = 1 << 20
    body = bytes(range(256)) * (3 * mib // 256)
    late, middle = bytearray(body), bytearray(body)
    late[-1] ^= 1
    middle[mib + 5] ^= 1  # in no slice that the signature reads
    files = {"a.bin": body, "b.bin": body, "late.bin": bytes(late), "middle.bin": bytes(middle), "zero1": b"", "zero2": b"", "small1": b"same", "small2": b"same", "small3": b"sane", "own": b"unlike all"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    root = f"file://{tmp_path}"
    listed = inventory_from_files(spark, root)
    signed = {r.full_path.rsplit("/", 1)[1]: r.quick_signature for r in file_signatures(listed, root).collect()}
    assert signed["a.bin"] == signed["b.bin"] == signed["middle.bin"] != signed["late.bin"]
    groups = {}
    for r in dedupe.duplicate_file_members(listed, root).collect():
        groups.setdefault(r.sha256_hash, set()).add(r.full_path.rsplit("/", 1)[1])
    assert sorted(map(sorted, groups.values())) == [["a.bin", "b.bin"], ["small1", "small2"], ["zero1", "zero2"]]
    assert dedupe.duplicate_file_members(listed.filter("false"), root).count() == 0


def test_a_run_skips_what_is_gone_and_fails_on_what_cannot_be_read(spark):
    folder = new_path(spark, "partial")
    rows = table(spark, [("/s/a.txt", "dup", 0), ("/s/b.txt", "dup", 1), ("/s/c.txt", "c"), ("/s/d.txt", "d"), ("/s/e.txt", "e")])
    current = spark.createDataFrame([("/s/a.txt", None), ("/s/c.txt", "denied"), ("/s/d.txt", None), ("/s/e.txt", None)], "full_path string, error string")
    assert apply(rows, RunOptions("/s", "/t", organize_mode="move"), folder, "t", current).first() == (0, 3, 0, 0, 1, 1)
    assert [r.full_path for r in read_issues(spark, folder, "skipped").collect()] == ["/s/b.txt"]
    assert [r.message for r in read_issues(spark, folder, "errors").collect()] == ["Could not organize (path='/s/c.txt'): denied"]
    states, entries = journal.read_table(spark, folder, "transactions"), journal.read_table(spark, folder, "journal_entries")
    assert {r.source_path: r.status for r in journal.current_entries(entries).collect()} == {"/s/a.txt": "done", "/s/c.txt": "failed", "/s/d.txt": "done", "/s/e.txt": "done"}
    assert journal.recoverable_transactions(states, entries).count() == 1
    counters, errors = undo(spark, folder, "t", rows.filter("full_path <> '/s/d.txt'"))
    assert tuple(counters.first()) == (0, 3, 0, 1) and [r.message for r in errors.collect()] == ["After undo a record is missing: /s/d.txt"]


def test_a_stopped_run_is_recovered(spark):
    folder = new_path(spark, "stopped")
    rows = table(spark, [("/s/a", "dup"), ("/s/b", "dup"), ("/s/c", "c")])
    asked = iter([False, True])
    with pytest.raises(Cancelled):
        apply(rows, RunOptions("/s", "/t"), folder, "t", stop=lambda: next(asked))
    states = journal.read_table(spark, folder, "transactions")
    assert [(r.checkpoint_stage, r.checkpoint_processed) for r in states.orderBy("updated_at_utc").collect()] == [("created", 0), ("dedupe", 0), ("cancelled", 1)]
    assert [(r.transaction_id, r.duplicates_quarantined) for r in recover(spark, folder, rows).collect()] == [("t", 1)]
    states = journal.read_table(spark, folder, "transactions")
    assert journal.current_transactions(states).first().lifecycle_status == "rolled_back"
    assert journal.recoverable_transactions(states, journal.read_table(spark, folder, "journal_entries")).count() == 0


def test_a_broken_run_is_taken_up_and_a_done_one_left_alone(spark, monkeypatch):
    folder = new_path(spark, "broken")
    rows = table(spark, [("/s/a.txt", "dup"), ("/s/b.txt", "dup"), ("/s/c.jpg", "c"), ("/s/d e=f.txt", "d")])
    options = RunOptions("/s", "/t")
    placed = journal.placed_rows

    def failing(plan, inventory, transaction_id):
        out = placed(plan, inventory, transaction_id)
        lost = F.when(F.col("name") == "c.jpg", F.raise_error(F.lit("executor lost"))).otherwise(F.col("content")).cast("string")
        return out.withColumn("content", lost)

    monkeypatch.setattr(journal, "placed_rows", failing)
    with pytest.raises(PySparkException):
        apply(rows, options, folder, "t")
    monkeypatch.undo()
    assert read_records(spark, folder, "organized").count() == 0 and read_records(spark, folder, "quarantine").count() == 1
    states, entries = journal.read_table(spark, folder, "transactions"), journal.read_table(spark, folder, "journal_entries")
    assert {r.status for r in journal.current_entries(entries).filter("action = 'copied'").collect()} == {"pending"}
    assert [r.transaction_id for r in journal.recoverable_transactions(states, entries).collect()] == ["t"]
    for _ in range(3):
        assert apply(rows, options, folder, "t").first() == (3, 0, 1, 0, 0, 0)
        assert sorted(r.name for r in read_records(spark, folder, "organized").collect()) == ["a.txt", "c.jpg", "d e=f.txt"]
        assert journal.read_table(spark, folder, "journal_entries").count() == 8
    assert commit.sweep(folder) == 0
    undo(spark, folder, "t")
    with pytest.raises(ValueError, match="was undone"):
        apply(rows, options, folder, "t")


def test_drafts_are_seen_when_they_are_committed(spark):
    folder = new_path(spark, "drafts")
    rows = spark.createDataFrame([(1, "a b/c", None), (2, "é", "x"), (3, "a b/c", "y")], "id int, place string, note string")
    schema = "id int, note string, place string, transaction_id string"

    def seen():
        return sorted((r.id, r.place, r.transaction_id) for r in commit.read_published(spark, folder, "d", schema).collect())

    commit.prepare(rows, folder, "t/1", "s", "d", ("place",))
    assert seen() == []
    with pytest.raises(ValueError, match="not prepared: e"):
        commit.publish(folder, "t/1", "s", ["d", "e"])
    commit.prepare(rows.filter("id < 3"), folder, "t/1", "s", "d", ("place",))  # takes the place of the first
    assert commit.publish(folder, "t/1", "s", ["d"]) and seen() == [(1, "a b/c", "t/1"), (2, "é", "t/1")]
    commit.prepare(rows, folder, "t/1", "s", "d", ("place",))
    assert not commit.publish(folder, "t/1", "s", ["d"]) and len(seen()) == 2
    commit.prepare(rows.filter("false"), folder, "t2", "s", "d", ("place",))
    assert commit.publish(folder, "t2", "s", ["d"]) and len(seen()) == 2
    commit.prepare(rows.filter("id = 3"), folder, "t/1", "s", "d", ("place",))
    assert commit.publish(folder, "t/1", "s", ["d"], replace=True) and seen() == [(3, "a b/c", "t/1")]
    assert commit.sweep(folder) == 0


def test_a_repeated_batch_changes_nothing(spark, monkeypatch):
    from recordloom.streaming import intake

    monkeypatch.setattr(levels, "MERGE_AFTER", 2)
    monkeypatch.setattr(levels, "BUCKETS", 2)
    folder = new_path(spark, "repeated")
    batches = [[("/a", "x", 1), ("/b", "y", 0)], [("/c", "x", 0), ("/d", "z", 0)], [("/a", "x", 1), ("/e", "z", 5)]]

    def feed(i):
        intake.intake_batch(table(spark, batches[i]), i, f"{folder}/store", f"{folder}/out")

    def seen():
        return sorted(tuple(r) for r in read_intake(spark, f"{folder}/out").select("batch", "full_path", "is_duplicate", "reused").collect())

    for i in range(3):
        feed(i)
    once = seen()
    assert once == [(0, "/a", False, False), (0, "/b", False, False), (1, "/c", True, False), (1, "/d", False, False), (2, "/a", True, True), (2, "/e", True, False)]
    for i in (2, 0, 1, 2):
        feed(i)
        assert seen() == once


def test_only_a_batch_s_own_buckets_are_read_and_written(spark, monkeypatch):
    """Other buckets' files stay as they are, and can even be unreadable."""
    monkeypatch.setattr(levels, "MERGE_AFTER", 2)
    monkeypatch.setattr(levels, "BUCKETS", 256)
    folder = new_path(spark, "buckets")
    local = folder.removeprefix("file:")
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v"))
    levels.write_delta(rows, folder, "key", 0)
    few = rows.filter("v in (5, 1700)").withColumn("v", -F.col("v"))
    own = levels.buckets_of(few, "key")
    others = [os.path.join(d, f) for d, _, files in os.walk(f"{local}/rows") for f in files if f.endswith(".parquet") and not any(f"bucket={b}/" in f"{d}/" for b in own)]
    assert len(own) == 2 and len(others) > 200
    for path in others:
        with open(path, "wb") as broken:
            broken.write(b"not a table")
    for batch in (1, 2, 3, 2):
        levels.write_delta(few.withColumn("v", F.col("v") - batch), folder, "key", batch)
        merged = levels.merge(spark, folder, "key string, v long", ["key"], own, batch)
        assert merged == (own if batch in (1, 3) else []) or batch == 2
    seen = {before: {r.key: r.v for r in levels.newest(levels.read_buckets(spark, folder, "key string, v long", own, before), ["key"]).filter("key in ('k5', 'k1700')").collect()} for before in (0, 1, 2, 3, 4)}
    assert seen == {0: {}, 1: {"k5": 5, "k1700": 1700}, 2: {"k5": -6, "k1700": -1701}, 3: {"k5": -7, "k1700": -1702}, 4: {"k5": -8, "k1700": -1703}}
    whole = levels.read_buckets(spark, folder, "key string, v long", own, 4)
    assert levels.newest(whole, ["key"]).count() == rows.filter(levels.bucket("key").isin(own)).count()
    assert levels.vacuum(spark, folder, 4) > 0 and levels.newest(levels.read_buckets(spark, folder, "key string, v long", own, 4), ["key"]).count() == levels.newest(whole, ["key"]).count()
    assert all(open(path, "rb").read() == b"not a table" for path in others) and levels.last_batch(folder) == 3


def test_a_path_with_new_content_leaves_its_old_content_free(spark, monkeypatch):
    from recordloom.streaming import intake

    monkeypatch.setattr(levels, "MERGE_AFTER", 2)
    folder = new_path(spark, "changed")
    for i, rows in enumerate([[("/a", "x", 1)], [("/a", "y", 2)], [("/b", "x", 3)], [("/c", "y", 3), ("/a", "y", 2)], [("/d", "y", 4), ("/e", "x", 4)]]):
        intake.intake_batch(table(spark, rows), i, f"{folder}/store", f"{folder}/out")
    seen = {(r.batch, r.full_path): (r.is_duplicate, r.reused) for r in read_intake(spark, f"{folder}/out").collect()}
    assert seen == {(0, "/a"): (False, False), (1, "/a"): (False, False), (2, "/b"): (False, False), (3, "/c"): (True, False), (3, "/a"): (False, True), (4, "/d"): (True, False), (4, "/e"): (True, False)}


def test_released_tables_are_gone(spark, tmp_path):
    from recordloom.operators import storage

    kept = storage.shared_dir(spark)
    storage._noted.add(f"{tmp_path}/recordloom-{spark.sparkContext.applicationId}")
    spark.range(3).write.parquet(f"{tmp_path}/recordloom-{spark.sparkContext.applicationId}/x")
    storage._noted.discard(kept)  # other tests still read theirs
    storage.release(spark)
    assert not any(tmp_path.iterdir())
    storage._noted.clear()
    storage._noted.add(kept)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 1000])
def test_narrowing_moves_no_row(spark, limit):
    """All wanted rows and few others, by plans without an exchange of rows, on either side of the broadcast limit."""
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("a"), F.concat(F.lit("k"), "id").alias("b"), F.lit("content").alias("content"))
    rows = rows.unionByName(spark.createDataFrame([(None, "k1", "c"), (7, None, "c")], "a long, b string, content string"))
    wanted = materialize(rows.filter("a % 50 = 3 and b is not null").select("a", "b").limit(300), "wanted")
    kept = narrowed(rows, wanted, ["a", "b"], limit)
    found, want = {(r.a, r.b) for r in kept.collect()}, {(r.a, r.b) for r in wanted.collect()}
    assert want <= found and len(found) < len(want) + 20
    assert "hashpartitioning" not in plan_of(kept).split("BroadcastExchange")[0] and "SortMergeJoin" not in plan_of(kept)
    assert narrowed(rows, wanted.filter("false"), ["a", "b"], limit).count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_content_stays_where_it_lies(spark, limit):
    rows = materialize(table(spark, [(f"/s/{k}", "x" * (k % 40 + k % 3)) for k in range(120)]), "rows")
    for frame in (
        dedupe.colliding(rows, limit),
        reuse.missing_digests(rows, materialize(rows.limit(50).select("full_path", "size_bytes", F.unix_micros("last_write_utc").alias("mtime_us")), "missing"), sha256, limit),
        narrowed(rows, materialize(rows.limit(50).select("full_path"), "shared"), ["full_path"], limit),
    ):
        above = plan_of(frame).split("BroadcastExchange")[0]
        assert "Exchange" not in above and frame.count() >= 50
    one, other = (dedupe.sharing_content(rows, materialize(rows.select("full_path", sha256(F.col("content")).alias("sha256_hash")), "all"), n) for n in (0, 1000))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_wide_vectors_are_refused(spark):
    from recordloom.functions.fingerprints import sign_bits

    frame = spark.createDataFrame([([1.0, -1.0, 2.0],)], "v array<float>")
    assert frame.select(sign_bits(F.col("v"))).first()[0] == 5
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([([1.0] * 65,)], "v array<float>").select(sign_bits(F.col("v"))).collect()


@pytest.mark.parametrize("limit", [0, 1, 299, 300, 500, 999, 1000, 5000])
def test_selection_is_that_of_a_sort(spark, limit):
    from recordloom.operators.ordering import largest

    # a third of all rows has one value, some have none, and paths decide between equals
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(500)).when(F.col("id") % 7 != 0, F.col("id") * 7919 % 1000).alias("v"), F.lpad(F.col("id").cast("string"), 4, "0").alias("path"))
    want = sorted(rows.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.path))[:limit]
    assert sorted(r.path for r in largest(rows, limit, F.col("v"), [F.col("path")]).collect()) == sorted(r.path for r in want)


def test_selection_sorts_the_bracket_alone(spark):
    from recordloom.operators import ordering

    rows = spark.range(40_000).select(F.col("id").alias("v"))
    chosen = ordering.largest(rows, 20_000, F.col("v"), [])
    assert chosen.agg(F.min("v"), F.count("*")).first() == (20_000, 20_000)
    # what was sorted is the written table named "ordered"; the plan reads it beside the rows above the bracket
    files = [f for f in chosen.inputFiles() if "/ordered-" in f]
    assert 0 < spark.read.parquet(*files).count() < 400


@pytest.mark.parametrize("entered", [1, 3, 1000])
def test_rounds_list_what_one_task_lists(spark, tmp_path, entered):
    deep = tmp_path.joinpath(*(f"level{i}" for i in range(15)))
    wide = [tmp_path / "wide" / f"w{i}" for i in range(30)]
    for folder in (deep, *wide, tmp_path / "wide" / ".recordloom", tmp_path / "empty"):
        folder.mkdir(parents=True)
        if folder.name != "empty":
            (folder / "own.txt").write_text(folder.name)
    os.symlink(tmp_path, tmp_path / "wide" / "loop")
    root = f"file://{tmp_path}"
    want = sorted(map(tuple, inventory_from_files(spark, root).collect()))
    assert len(want) == 31
    assert sorted(map(tuple, snapshot_of_files(spark, root, entered=entered).collect())) == want
    missing = snapshot_of_files(spark, f"{root}/missing").collect()
    assert len(missing) == 1 and missing[0].error
    assert snapshot_of_files(spark, f"{root}/empty").count() == 0


def test_stateful_intake_over_restarts(spark):
    from recordloom.streaming.stateful import read_marked, stateful_intake

    folder = new_path(spark, "stateful")
    schema = "full_path string, size_bytes long, last_write_utc timestamp, content string"
    batches = [
        [("/a", 1, 5, "x"), ("/b", 1, 3, "x"), ("/c", 1, 3, "y"), ("/n", None, None, None)],
        [("/b", 1, 3, "x"), ("/c", 1, 3, "y"), ("/d", 1, 1, "y"), ("/n2", None, 1, None), ("/e", 0, None, "")],
        # many copies, one of them older than the rest and one of them there already
        [("/e", 0, 9, "")] + [(f"/m{i:05d}", 1, 9 if i != 700 else 2, "z") for i in range(2000)],
        [("/m00700", 1, 2, "z"), ("/e", 0, None, "")],
    ]
    for rows in batches:
        typed = [(p, s, None if t is None else datetime.fromtimestamp(t, tz=timezone.utc), c) for p, s, t, c in rows]
        spark.createDataFrame(typed, schema).repartition(3).write.mode("append").parquet(f"{folder}/in")
        stateful_intake(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = read_marked(spark, f"{folder}/out").collect()
    assert len(found) == sum(map(len, batches))
    copies = {(r.batch, r.full_path): r.is_duplicate for r in found}
    assert {k: v for k, v in copies.items() if k[0] < 2} == {(0, "/a"): True, (0, "/b"): False, (0, "/c"): False, (0, "/n"): False, (1, "/b"): True, (1, "/c"): True, (1, "/d"): True, (1, "/n2"): False, (1, "/e"): False}
    assert sorted(p for (b, p), v in copies.items() if b == 2 and not v) == ["/e", "/m00700"]
    assert copies[3, "/m00700"] and not copies[3, "/e"]


@pytest.mark.parametrize(("ttl_ms", "copy"), [(3_600_000, True), (1, False)])
def test_stateful_intake_forgets(spark, ttl_ms, copy):
    from recordloom.streaming.stateful import read_marked, stateful_intake

    folder = new_path(spark, "forget")
    schema = "full_path string, size_bytes long, last_write_utc timestamp, content string"
    for path in ("/a", "/b"):
        spark.createDataFrame([(path, 1, None, "x")], schema).write.mode("append").parquet(f"{folder}/in")
        stateful_intake(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", ttl_ms).awaitTermination()
    assert {r.full_path: r.is_duplicate for r in read_marked(spark, f"{folder}/out").collect()} == {"/a": False, "/b": copy}


@pytest.mark.parametrize(("width", "height"), [(9, 8), (4, 3), (1, 1)])
def test_bitmaps_are_read_back(spark, tmp_path, width, height):
    from recordloom.functions.pictures import gray_bitmap

    pixels = [(37 * i + 11) % 256 for i in range(width * height)]
    frame = spark.createDataFrame([(pixels,), (pixels[:-1],), ([256] * len(pixels),)], "p array<int>")
    made = [r[0] for r in frame.select(gray_bitmap(F.col("p"), width, height)).collect()]
    assert made[1:] == [None, None]
    (tmp_path / "one.bmp").write_bytes(made[0])
    read = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert (read.width, read.height) == (width, height) and list(read.data[::3]) == pixels


def test_files_arrive_once(spark, tmp_path):
    from recordloom.streaming.arrivals import current_digests, digest_arrivals, note_arrivals, read_digests

    tree, state = tmp_path / "tree", new_path(spark, "arrivals")
    tree.mkdir()
    root = f"file://{tree}"

    def take() -> int:
        n = note_arrivals(spark, root, f"{state}/arrivals")
        if os.path.isdir(f"{state}/arrivals".removeprefix("file:")):
            digest_arrivals(spark, root, f"{state}/arrivals", f"{state}/out", f"{state}/checkpoint").awaitTermination()
        return n

    assert take() == 0  # an empty folder
    (tree / "a").write_text("one")
    (tree / "b").write_text("")
    assert take() == 2 and take() == 0
    (tree / "a").write_text("other")
    (tree / "c").write_text("one")
    assert note_arrivals(spark, root, f"{state}/arrivals") == 2
    (tree / "c").unlink()  # gone before it is read
    assert take() == 0
    seen = [(r.batch, r.full_path.rsplit("/", 1)[1], r.size_bytes, r.sha256_hash is None, r.read_error is None) for r in read_digests(spark, f"{state}/out").collect()]
    assert sorted(seen) == [(0, "a", 3, False, True), (0, "b", 0, False, True), (1, "a", 5, False, True), (1, "c", 3, True, False)]
    assert sorted((r.full_path.rsplit("/", 1)[1], r.size_bytes) for r in current_digests(spark, f"{state}/out").collect()) == [("a", 5), ("b", 0), ("c", 3)]
