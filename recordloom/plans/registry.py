"""Every query of the library by name, with the DuckDB SQL that checks it.

All start from one inventory: ``documents`` seen as records of a lake, with a path and a time
derived from doc_id. Other inputs (protected paths, an earlier fingerprint snapshot, a journal,
names already in the target) are derived from the same rows by fixed rules.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import columns as C
from recordloom.functions.filters import SIMILARITY_EXTENSIONS, ScanFilter
from recordloom.functions.fingerprints import hex16, sha256, sign_bits, simhash
from recordloom.functions.fingerprints import bands as band_array
from recordloom.operators import dedupe, journal, plan, report, reuse, similar
from recordloom.operators.names import free_names
from recordloom.operators.ordering import numbered
from recordloom.operators.storage import materialize, new_path
from recordloom.plans.run import RunOptions, preview
from recordloom.sources import inventory as source
from recordloom.sources.synthetic import synthetic_inventory
from recordloom.streaming import intake

QUERIES: dict = {}
SQL: dict[str, str] = {}

_PATH = """concat('/lake/', source, '/', case when doc_id % 37 = 0 then '.state/' else '' end, 'd', cast(floor(doc_id / 8) as bigint), '/',
  case when doc_id % 41 = 0 then '.' else '' end, 'doc_', doc_id % 8,
  element_at(array('.txt','.md','.JPG','.png','.mp4','.mp3','.pdf','.zip','.sh','.bin','','.tif'), cast(doc_id % 12 as int) + 1))"""
_TIME = "timestamp_seconds(1704067200 + (doc_id * 7919 % 61) * 86400)"
RESERVED = (".state",)
ROOT, TARGET, ZONE = "/lake/src0", "/organized", "America/Los_Angeles"


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents inventory with content and doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return source.inventory_from_table(docs, F.expr(_PATH), F.col("text"), F.expr(_TIME), F.col("doc_id"))


# ---- SQL parts -------------------------------------------------------------

_CATEGORY = "case " + " ".join(f"when extension in ({', '.join(map(repr, own))}) then '{c}'" for c, own in C.CATEGORY_EXTENSIONS.items()) + " else 'other' end"
_FOLDER = "case category " + " ".join(f"when '{c}' then '{f}'" for c, f in C.FOLDERS.items()) + " end"
_BASE = f"""base as (select doc_id,
  concat('/lake/', source, '/', case when doc_id % 37 = 0 then '.state/' else '' end, 'd', doc_id // 8, '/',
    case when doc_id % 41 = 0 then '.' else '' end, 'doc_', doc_id % 8,
    (['.txt','.md','.JPG','.png','.mp4','.mp3','.pdf','.zip','.sh','.bin','','.tif'])[doc_id % 12 + 1]) as full_path,
  cast(strlen(text) as bigint) as size_bytes,
  make_timestamp((1704067200 + (doc_id * 7919 % 61) * 86400) * 1000000) as last_write_utc, text as content from documents),
named as (select *, regexp_extract(full_path, '[^/]*$') as name from base),
typed as (select *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) as extension from named),
inv as (select *, {_CATEGORY} as category, {_FOLDER} as folder from (select *, {_CATEGORY} as category from typed))""".replace(f"select *, {_CATEGORY} as category, {_FOLDER}", f"select *, {_FOLDER}")
_GROUPS = """hashed as (select *, sha256(content) as sha256_hash from inv),
counted as (select *, count(*) over (partition by sha256_hash, size_bytes) as group_size,
  cast(row_number() over (partition by sha256_hash, size_bytes order by last_write_utc, lower(full_path), full_path) as int) as group_rank from hashed),
members as (select * from counted where group_size > 1)"""
_KEEP = """flagged as (select *, doc_id % 11 = 0 as is_protected, bool_or(doc_id % 11 = 0) over (partition by sha256_hash, size_bytes) as any_protected from members),
kept as (select *, case when any_protected then is_protected else group_rank = 1 end as keep from flagged)"""


def _size_text(col: str) -> str:
    units = ["KB", "MB", "GB", "TB", "PB"]
    cases = "".join(f" when {col} < {1024 ** (k + 1)} then printf('%.2f {u}', {col} / {float(1024**k)})" for k, u in enumerate(units[:-1], start=1))
    return f"case when {col} < 1024 then printf('%d B', {col}){cases} else printf('%.2f PB', {col} / {float(1024**5)}) end"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


_INV = _with(_BASE)
_MEM = _with(_BASE, _GROUPS)
_KEPT = _with(_BASE, _GROUPS, _KEEP)
_NUM = "case when n > 0 then concat(regexp_replace(name, '^(.+)\\.[^.]+$', '\\1'), ' (', n, ')', regexp_extract(name, '^.+(\\.[^.]+)$', 1)) else name end"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


# ---- inventory and scalar columns -------------------------------------------

query("inventory", _INV + "select full_path, extension, size_bytes, last_write_utc, category from inv")(lambda s, d: inventory(s, d).select(*source.COLUMNS))
query("file_parts", _INV + "select full_path, name, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') as stem, regexp_replace(full_path, '/[^/]*$', '') as parent from inv")(
    lambda s, d: inventory(s, d).select("full_path", C.file_name(F.col("full_path")).alias("name"), C.stem(C.file_name(F.col("full_path"))).alias("stem"), C.parent(F.col("full_path")).alias("parent"))
)
query("normalize_extension", _INV + "select full_path, case when trim(e) = '' then '' when starts_with(trim(e), '.') then lower(trim(e)) else '.' || lower(trim(e)) end as ext from (select full_path, case when doc_id % 2 = 0 then ' ' || upper(ltrim(extension, '.')) || ' ' else extension end as e from inv)")(
    lambda s, d: inventory(s, d).select("full_path", C.normalize_extension(F.expr("case when doc_id % 2 = 0 then ' ' || upper(ltrim('.', extension)) || ' ' else extension end")).alias("ext"))
)
query("classify", _INV + "select category, count(*) as n, cast(sum(size_bytes) as bigint) as bytes from inv group by 1")(
    lambda s, d: inventory(s, d).groupBy("category").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
)
query("folder", _INV + "select full_path, folder from inv")(lambda s, d: inventory(s, d).select("full_path", C.folder_name(F.col("category")).alias("folder")))
query("season", _INV + "select full_path, case when month(last_write_utc) in (12, 1, 2) then 'Winter' when month(last_write_utc) <= 5 then 'Spring' when month(last_write_utc) <= 8 then 'Summer' else 'Fall' end as season from inv")(
    lambda s, d: inventory(s, d).select("full_path", C.season(F.month("last_write_utc")).alias("season"))
)
query("format_size", _INV + f"select full_path, {_size_text('b')} as size_text from (select full_path, cast(size_bytes * (1 + doc_id % 7 * 100000) as bigint) as b from inv)")(
    lambda s, d: inventory(s, d).select("full_path", C.format_size(F.expr("size_bytes * (1 + doc_id % 7 * 100000)")).alias("size_text"))
)
query("destination", _INV + f"select full_path, concat('{TARGET}/', folder, '/', strftime(t, '%Y/%m')) as destination from (select *, (last_write_utc::timestamp - interval 8 hour) as t from inv)")(
    lambda s, d: inventory(s, d).select("full_path", C.destination_folder(TARGET, F.col("category"), F.col("last_write_utc"), ZONE).alias("destination"))
)
query("relative_path", _INV + f"select full_path, case when starts_with(full_path, '{ROOT}/') then substr(full_path, {len(ROOT) + 2}) else name end as relative from inv")(
    lambda s, d: inventory(s, d).select("full_path", C.relative_path(F.col("full_path"), ROOT).alias("relative"))
)
query("sub_path", _INV + f"select full_path, starts_with(full_path, '{ROOT}/') as below, false as same from inv")(
    lambda s, d: inventory(s, d).select("full_path", C.is_sub_path(F.col("full_path"), F.lit(ROOT + "/")).alias("below"), C.paths_equal(F.col("full_path"), F.lit(ROOT)).alias("same"))
)
query("fingerprint_key", _INV + "select full_path, size_bytes, epoch_us(last_write_utc) as mtime_us from inv")(lambda s, d: inventory(s, d).select(*C.fingerprint_key()))
query("content_digest", _INV + "select full_path, sha256(content) as sha256 from inv")(lambda s, d: inventory(s, d).select("full_path", sha256(F.col("content")).alias("sha256")))
query("error_text", _INV + "select full_path, concat('Could not read (path=''', full_path, ''', mode=''scan'', size=', size_bytes, '): ', case when doc_id % 2 = 0 then 'denied' else 'gone' end) as message from inv")(
    lambda s, d: inventory(s, d).select("full_path", C.error_message("Could not read", F.col("full_path"), {"size": F.col("size_bytes"), "mode": F.lit("scan")}, F.expr("case when doc_id % 2 = 0 then 'denied' else 'gone' end")).alias("message"))
)

# ---- filters ------------------------------------------------------------------

_FROM, _TO = datetime(2024, 1, 15, tzinfo=timezone.utc), datetime(2024, 2, 10, tzinfo=timezone.utc)
_ALL = ScanFilter([".txt", "md", "JPG", "pdf", ".sh"], [".sh"], 200, 5000, _FROM, _TO, True)
_HID = "not starts_with(name, '.')"
_UNRESERVED = "not contains(full_path, '/.state/')"
_FILTERS = {
    "filter_ext": (ScanFilter([".txt", " MD", "jpg"], ["md"], exclude_hidden=False), "extension in ('.txt', '.md', '.jpg') and extension <> '.md'"),
    "filter_size": (ScanFilter(min_size=500, max_size=2000, exclude_hidden=False), "size_bytes between 500 and 2000"),
    "filter_date": (ScanFilter(from_utc=_FROM, to_utc=_TO, exclude_hidden=False), "last_write_utc between timestamp '2024-01-15' and timestamp '2024-02-10'"),
    "filter_hidden": (ScanFilter(), _HID),
    "filter_all": (_ALL, f"extension in ('.txt', '.md', '.jpg', '.pdf') and size_bytes between 200 and 5000 and last_write_utc between timestamp '2024-01-15' and timestamp '2024-02-10' and {_HID}"),
}
for _name, (_options, _where) in _FILTERS.items():
    query(_name, _INV + f"select full_path, size_bytes, last_write_utc from inv where {_UNRESERVED} and {_where}")(
        lambda s, d, o=_options: source.scan(inventory(s, d), o, RESERVED).select("full_path", "size_bytes", "last_write_utc")
    )
query(
    "rejected_rows",
    _INV
    + f"""select * from (select full_path, case when extension not in ('.txt', '.md', '.jpg', '.pdf', '.sh') then 'extension not included' when extension = '.sh' then 'extension excluded'
 when size_bytes < 200 then 'too small' when size_bytes > 5000 then 'too large' when last_write_utc < timestamp '2024-01-15' then 'too old'
 when last_write_utc > timestamp '2024-02-10' then 'too new' when not {_HID} then 'hidden' end as reject_reason from inv where {_UNRESERVED}) where reject_reason is not null""",
)(lambda s, d: source.rejected_rows(inventory(s, d), _ALL, RESERVED).drop("error"))
query("similarity_eligible", _INV + f"select full_path from inv where extension in ({', '.join(map(repr, SIMILARITY_EXTENSIONS))})")(
    lambda s, d: inventory(s, d).filter(F.col("extension").isin(*SIMILARITY_EXTENSIONS)).select("full_path")
)
query("scan_summary", _INV + "select count(*) as total_files_scanned, cast(coalesce(sum(size_bytes), 0) as bigint) as total_bytes_scanned from inv")(lambda s, d: source.scan_summary(inventory(s, d)))
query("scan_order", _INV + "select full_path, category, row_number() over (order by category, last_write_utc, lower(full_path), full_path) as seq from inv")(
    lambda s, d: numbered(inventory(s, d).drop("content"), [F.col("category"), *dedupe.member_order()]).select("full_path", "category", "seq")
)

# ---- exact duplicates -----------------------------------------------------------


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_members(inventory(spark, sf_dir))


query("size_collisions", _INV + "select size_bytes, count(*) as n from inv group by 1 having count(*) > 1")(lambda s, d: dedupe.size_collisions(inventory(s, d)))
query("quick_collisions", _MEM + "select size_bytes, count(*) as n from members group by sha256_hash, size_bytes")(lambda s, d: dedupe.quick_collisions(inventory(s, d)))
query("sha_collisions", _MEM + "select size_bytes, sha256_hash, count(*) as n from members group by 1, 2")(lambda s, d: dedupe.sha_collisions(inventory(s, d)))
query("byte_verified", _INV + "select full_path, size_bytes, sha256(content) as sha256_hash, class_size from (select *, count(*) over (partition by content) as class_size from inv) where class_size > 1")(
    lambda s, d: dedupe.byte_verified(inventory(s, d))
)
query("duplicate_members", _MEM + "select sha256_hash, size_bytes, full_path, last_write_utc, group_size, group_rank from members")(members)
query("duplicate_groups", _MEM + "select sha256_hash, size_bytes, count(*) as n, max(case when group_rank = 1 then full_path end) as first_path from members group by 1, 2")(
    lambda s, d: dedupe.group_order(dedupe.group_summary(members(s, d)))
)
query("dedupe_summary", _MEM + "select count(*) as duplicate_group_count, cast(coalesce(sum(n - 1), 0) as bigint) as duplicate_files_found, cast(coalesce(sum(size_bytes * (n - 1)), 0) as bigint) as duplicate_bytes_reclaimable from (select size_bytes, count(*) as n from members group by sha256_hash, size_bytes)")(
    lambda s, d: dedupe.dedupe_summary(members(s, d))
)
query("top_groups", _MEM + "select sha256_hash, size_bytes, count(*) as n, max(case when group_rank = 1 then full_path end) as first_path from members group by 1, 2 order by n desc, size_bytes desc, sha256_hash limit 10")(
    lambda s, d: dedupe.top_groups(members(s, d))
)

# ---- keep and plan ----------------------------------------------------------------


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).filter("doc_id % 11 = 0").select("full_path")


query("keepers", _MEM + "select full_path, sha256_hash, group_rank = 1 as keep from members")(lambda s, d: plan.keepers(members(s, d)).select("full_path", "sha256_hash", "keep"))
query("keepers_protected", _KEPT + "select full_path, sha256_hash, is_protected, keep from kept")(lambda s, d: plan.keepers(members(s, d), protected(s, d)).select("full_path", "sha256_hash", "is_protected", "keep"))
query("survivors", _KEPT + "select full_path, size_bytes from inv where full_path not in (select full_path from kept where not keep)")(
    lambda s, d: plan.survivors(inventory(s, d), plan.removals(members(s, d), protected(s, d))).select("full_path", "size_bytes")
)
query("group_keep_summary", _KEPT + f"""select substr(sha256_hash, 1, 12) as hash12, n - greatest(np, 1) as removable, {_size_text('size_bytes')} as size_text,
 case when np > 1 then np || ' protected' else kept_path end as keep_text from
 (select sha256_hash, size_bytes, count(*) as n, count(*) filter (where is_protected) as np, arg_min(full_path, group_rank) filter (where keep) as kept_path from kept group by 1, 2)""")(
    lambda s, d: plan.group_keep_summary(members(s, d), protected(s, d))
)
query("preview_estimates", _MEM + "select cast(r as bigint) as would_quarantine, cast(greatest(0, (select count(*) from inv) - r) as bigint) as would_organize from (select coalesce(sum(n - 1), 0) as r from (select count(*) as n from members group by sha256_hash, size_bytes))")(
    lambda s, d: plan.preview_estimates(source.scan_summary(inventory(s, d)), dedupe.dedupe_summary(members(s, d)))
)
_SEQ = "row_number() over (order by group_size desc, size_bytes desc, sha256_hash, group_rank) as seq"
query("dedupe_plan_off", "select cast(0 as bigint) as seq, '' as action, '' as source_path, '' as destination_path, true as reversible where false")(
    lambda s, d: plan.dedupe_plan(members(s, d), "off", ROOT)
)
query("dedupe_plan_delete", _KEPT + f"select {_SEQ}, 'deleted_duplicate' as action, full_path as source_path, cast(null as varchar) as destination_path, false as reversible from kept where not keep")(
    lambda s, d: plan.dedupe_plan(members(s, d), "delete", ROOT, protected=protected(s, d))
)
_QUARANTINE = _KEPT + f""", rel as (select *, concat('/quarantine/', case when starts_with(full_path, '{ROOT}/') then substr(full_path, {len(ROOT) + 2}) else name end) as path from kept where not keep),
num as (select *, row_number() over (partition by path order by group_size desc, size_bytes desc, sha256_hash, group_rank) - 1 as n from rel)
select {_SEQ}, 'quarantined_duplicate' as action, full_path as source_path, concat(regexp_replace(path, '/[^/]*$', ''), '/', {_NUM}) as destination_path, true as reversible from num"""
query("dedupe_plan_quarantine", _QUARANTINE)(lambda s, d: plan.dedupe_plan(members(s, d), "quarantine", ROOT, protected=protected(s, d)))


def _organize_sql(action: str, rows: str) -> str:
    order = "category, last_write_utc, lower(full_path), full_path"
    return f""", slot as (select *, concat('{TARGET}/', folder, '/', strftime(last_write_utc, '%Y/%m')) as place from {rows}),
num as (select *, row_number() over (partition by place, name order by {order}) - 1 as n from slot)
select row_number() over (order by {order}) as seq, '{action}' as action, full_path as source_path, concat(place, '/', {_NUM}) as destination_path, true as reversible from num"""


_LEFT = "(select * from inv where full_path not in (select full_path from kept where not keep))"


def _organized(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    left = plan.survivors(inventory(spark, sf_dir), plan.removals(members(spark, sf_dir), protected(spark, sf_dir)))
    return plan.organize_plan(left.drop("content"), mode, TARGET)


query("organize_plan_copy", _KEPT + _organize_sql("copied", _LEFT))(lambda s, d: _organized(s, d, "copy"))
query("organize_plan_move", _KEPT + _organize_sql("moved", "inv"))(lambda s, d: plan.organize_plan(inventory(s, d).drop("content"), "move", TARGET))


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory(spark, sf_dir).filter("doc_id % 13 = 0")
    return rows.select(F.concat_ws("/", C.destination_folder(TARGET, F.col("category"), F.col("last_write_utc")), C.file_name(F.col("full_path"))).alias("full_path")).distinct()


query(
    "organize_plan_existing",
    _INV
    + f""", slot as (select *, concat('{TARGET}/', folder, '/', strftime(last_write_utc, '%Y/%m')) as place from inv),
taken as (select distinct place, name from slot where doc_id % 13 = 0),
num as (select s.*, row_number() over (partition by s.place, s.name order by category, last_write_utc, lower(full_path), full_path) - 1 + case when t.name is null then 0 else 1 end as n
  from slot s left join taken t on s.place = t.place and s.name = t.name)
select full_path as source_path, concat(place, '/', {_NUM}) as destination_path from num""",
)(lambda s, d: plan.organize_plan(inventory(s, d).drop("content"), "copy", TARGET, existing=_existing(s, d)).select("source_path", "destination_path"))


def _numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that want the same few names, many of which end in numbers, in twenty folders of which some names are taken: one after another, every record gets a name."""
    rows = inventory(spark, sf_dir).select("doc_id", F.expr("concat('/t/', doc_id % 20)").alias("place"), F.expr(_WANTED).alias("name"))
    there = rows.filter("doc_id % 13 = 0").select(F.concat_ws("/", "place", "name").alias("full_path")).distinct()
    return free_names(rows, "place", "name", [F.col("doc_id")], there).select("doc_id", "destination_path")


_WANTED = "concat('x', cast(floor(doc_id / 20) as int) % 3, case cast(floor(doc_id / 7) as int) % 4 when 0 then '' when 1 then ' (1)' when 2 then concat(' (', doc_id % 9 + 1, ')') else ' (1) (2)' end, '.txt')"
_FREE = "list_filter(range(0, len(s.taken) + 1), lambda k: not list_contains(s.taken, case when k > 0 then concat(w.stem, ' (', k, ').txt') else w.name end))[1]"
query(
    "numbered_names",
    f"""with recursive w as (select *, left(name, len(name) - 4) as stem, row_number() over (partition by place order by doc_id) as r from (select doc_id, concat('/t/', doc_id % 20) as place, {_WANTED} as name from documents)),
f as (select w.place, list(distinct name) filter (where doc_id % 13 = 0) as taken from w group by 1),
s as (select place, cast(0 as bigint) as r, coalesce(taken, []) as taken, cast(null as bigint) as doc_id, cast(null as varchar) as got from f
 union all select place, r, list_append(taken, got), doc_id, got from (select w.place, w.r, s.taken, w.doc_id, case when {_FREE} > 0 then concat(w.stem, ' (', {_FREE}, ').txt') else w.name end as got from s join w on w.place = s.place and w.r = s.r + 1))
select doc_id, concat(place, '/', got) as destination_path from s where r > 0""",
)(_numbered_names)
query("action_summary", _KEPT + "select cast(0 as bigint) as files_copied, cast(0 as bigint) as files_moved, count(*) as duplicates_quarantined, cast(0 as bigint) as duplicates_deleted from kept where not keep")(
    lambda s, d: plan.action_summary(plan.dedupe_plan(members(s, d), "quarantine", ROOT, protected=protected(s, d)))
)
query("still_there", _KEPT + "select full_path as source_path, doc_id % 17 <> 0 as acted from kept where not keep")(
    lambda s, d: (
        lambda pair: pair[0].select("source_path", F.lit(True).alias("acted")).unionByName(pair[1].select("source_path", F.lit(False).alias("acted")))
    )(plan.still_there(plan.removals(members(s, d), protected(s, d)).withColumnRenamed("full_path", "source_path"), inventory(s, d).filter("doc_id % 17 <> 0")))
)


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for scope in plan.SCOPES:
        for mode in plan.DEDUPE_MODES:
            result = preview(inventory(spark, sf_dir), RunOptions(ROOT, TARGET, scope, dedupe_mode=mode, filters=ScanFilter(exclude_hidden=False)))
            counts = []
            for actions in (result.removed, result.to_organize):
                counts.append(F.lit(0).cast("long") if actions is None else actions.agg(F.count("*")).scalar())
            rows.append(spark.range(1).select(F.lit(scope).alias("scope"), F.lit(mode).alias("mode"), counts[0].alias("deduped"), counts[1].alias("organized")))
    return plan.union_all(rows)


query(
    "scope_matrix",
    _MEM
    + """, r as (select cast(coalesce(sum(n - 1), 0) as bigint) as r, (select count(*) from inv) as t from (select count(*) as n from members group by sha256_hash, size_bytes)),
m as (select * from (values ('group_and_dedupe', true, true), ('group_only', true, false), ('dedupe_only', false, true)) s(scope, g, d), (values ('off'), ('quarantine'), ('delete')) x(mode))
select scope, mode, case when d and mode <> 'off' then r else 0 end as deduped, case when not g then 0 when d and mode <> 'off' then t - r else t end as organized from m, r""",
)(_scopes)

# ---- near duplicates ---------------------------------------------------------------

_TOK = "tok as (select doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT as h from (select doc_id, unnest(string_split(lower(text), ' ')) as w from documents) where w <> '')"
_SIM = """bit as (select doc_id, i, sum(case when (h >> i) & 1 = 1 then 1 else -1 end) as v from tok, range(64) t(i) group by 1, 2),
fp as materialized (select doc_id, bit_or(case when v > 0 then (1::UBIGINT << i::UBIGINT) else 0::UBIGINT end) as h from bit group by 1),
node as (select b.full_path, b.last_write_utc, fp.h from fp join base b using (doc_id)),
rep as materialized (select h, min(full_path) as full_path from node group by 1),
band as (select full_path, h, k, (h >> (16 * k)::UBIGINT) & 65535 as v from rep, range(4) t(k)),
cand as (select distinct a.full_path as a, b.full_path as b, bit_count(xor(a.h, b.h)) as distance from band a join band b on a.k = b.k and a.v = b.v and a.full_path < b.full_path)"""
_NEAR = _with(_BASE, _TOK, _SIM)


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(full_path, h) of every record with a word."""
    rows = simhash(inventory(spark, sf_dir).select("full_path", "content"), "full_path", "content")
    return materialize(rows.select("full_path", F.col("fp").alias("h")), "fingerprints")


query("simhash", _NEAR + "select full_path, lpad(lower(format('{:x}', h)), 16, '0') as fp from node")(lambda s, d: text_fingerprints(s, d).select("full_path", hex16(F.col("h")).alias("fp")))
query("embedding_bands", "with b as (select vec_id, bit_or(case when embedding[i + 1] > 0 then (1::UBIGINT << i::UBIGINT) else 0::UBIGINT end) as h from embeddings, range(64) t(i) group by 1) select vec_id, cast(k as int) as band_no, cast((h >> (16 * k)::UBIGINT) & 65535 as bigint) as band from b, range(4) t(k)")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.inline(band_array(sign_bits(F.col("embedding")))))
)
query("similar_candidates", _NEAR + "select a, b, cast(distance as int) as distance from cand")(lambda s, d: similar.similar_candidates(text_fingerprints(s, d)))
query("similar_pairs", _NEAR + "select a, b, cast(distance as int) as distance from cand where distance <= 8")(lambda s, d: similar.similar_pairs(text_fingerprints(s, d)))
_ALL_PAIRS = _NEAR + "select a.full_path as a, b.full_path as b, cast(bit_count(xor(a.h, b.h)) as int) as distance from rep a join rep b on a.full_path < b.full_path and bit_count(xor(a.h, b.h)) <= 8"
query("similar_pairs_exact", _ALL_PAIRS)(lambda s, d: similar.similar_pairs(text_fingerprints(s, d), exact=True))


def _recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all pairs at each distance the banded form finds."""
    return similar.recall_counts(text_fingerprints(spark, sf_dir))


query("similar_recall", _NEAR + "select cast(bit_count(xor(a.h, b.h)) as int) as distance, count(*) as pairs, count(c.a) as found from rep a join rep b on a.full_path < b.full_path and bit_count(xor(a.h, b.h)) <= 8 left join cand c on c.a = a.full_path and c.b = b.full_path group by 1")(_recall)


def _pair_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a limit on compared pairs refuses the clustering."""
    prints, rows = text_fingerprints(spark, sf_dir), []
    for limit in (0, 5, 1_000_000_000_000):
        try:
            similar.similar_clusters(prints, max_pairs=limit)
            rows.append((limit, False))
        except ValueError:
            rows.append((limit, True))
    return spark.createDataFrame(rows, "max_pairs long, refused boolean")


query("similar_pair_limit", _NEAR + "select max_pairs, (select count(*) from cand) > max_pairs as refused from (values (0::bigint), (5), (1000000000000)) t(max_pairs)")(_pair_limits)
query(
    "similar_split_buckets",
    _NEAR
    + """, sized as (select k, v, count(*) as records from (select n.h, k, (n.h >> (16 * k)::UBIGINT) & 65535 as v from node n, range(4) t(k)) group by 1, 2),
cut as (select b.full_path, b.h, b.k, b.v, case when s.records > 4 then cast((b.h >> ((16 * (b.k + 1)) % 64)::UBIGINT) & 255 as bigint) else -1 end as part from band b join sized s using (k, v))
select distinct least(a.full_path, b.full_path) as a, greatest(a.full_path, b.full_path) as b, cast(bit_count(xor(a.h, b.h)) as int) as distance from cut a join cut b on a.k = b.k and a.v = b.v and a.part = b.part and a.full_path < b.full_path""",
)(lambda s, d: similar.similar_candidates(text_fingerprints(s, d), limit=4))
query("similar_too_few", "select '' as full_path, cast(0 as bigint) as cluster from documents where false")(
    lambda s, d: similar.similar_clusters(text_fingerprints(s, d).join(inventory(s, d).agg(F.min("full_path").alias("full_path")), "full_path", "left_semi")).select("full_path", "cluster")
)
query("similar_membership", _NEAR + "select n.full_path, r.full_path as representative from node n join rep r using (h)")(lambda s, d: similar.similar_membership(text_fingerprints(s, d)))
_CLUSTER = _with(_BASE, _TOK, _SIM, "pair as materialized (select a, b from cand where distance <= 8 union all select b, a from cand where distance <= 8)", "reach(x, y) as (select a, a from pair union select r.x, p.b from reach r join pair p on r.y = p.a)").replace("with base", "with recursive base")
_ANCHOR = _CLUSTER + ", label as (select x, min(y) as cluster from reach group by 1), placed as (select n.full_path, n.last_write_utc, coalesce(l.cluster, r.full_path) as cluster from node n join rep r using (h) left join label l on l.x = r.full_path), mem as (select * from (select *, count(*) over (partition by cluster) as n from placed) where n > 1)"
query("similar_clusters", _ANCHOR + "select full_path, count(*) over (partition by cluster) as members from mem")(
    lambda s, d: (lambda rows: rows.join(rows.groupBy("cluster").agg(F.count("*").alias("members")), "cluster").select("full_path", "members"))(similar.similar_clusters(text_fingerprints(s, d)))
)
query("similar_groups", _ANCHOR + "select first_value(full_path) over (partition by cluster order by last_write_utc, lower(full_path), full_path) as anchor_path, full_path, count(*) over (partition by cluster) as group_size from mem")(
    lambda s, d: similar.similar_members(text_fingerprints(s, d), inventory(s, d))
)

# ---- fingerprint reuse ---------------------------------------------------------------


def prior_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier store: two rows of three, of which some have an older time."""
    rows = inventory(spark, sf_dir).filter("doc_id % 3 <> 0")
    time = F.unix_micros("last_write_utc") - F.when(F.col("doc_id") % 5 == 0, 1_000_000).otherwise(0)
    return rows.select("full_path", "size_bytes", time.alias("mtime_us"), sha256(F.col("content")).alias("sha256"), F.lit(None).cast("string").alias("quick_signature"), F.timestamp_seconds(1700000000 + F.col("doc_id")).alias("last_used"))


_HIT = "doc_id % 3 <> 0 and doc_id % 5 <> 0"
query("fingerprint_hits", _INV + f"select full_path, sha256(content) as sha256 from inv where {_HIT}")(lambda s, d: reuse.fingerprint_hits(inventory(s, d), prior_snapshot(s, d)).select("full_path", "sha256"))
query("fingerprint_misses", _INV + f"select full_path, size_bytes from inv where not ({_HIT})")(lambda s, d: reuse.fingerprint_misses(inventory(s, d), prior_snapshot(s, d)).select("full_path", "size_bytes"))
query("fingerprint_reuse", _INV + f"select full_path, sha256(content) as sha256, {_HIT} as reused from inv")(
    lambda s, d: reuse.with_fingerprints(inventory(s, d), prior_snapshot(s, d), sha256).select("full_path", "sha256", "reused")
)
query("fingerprint_upsert", _INV + f"select full_path, epoch_us(last_write_utc) as mtime_us, sha256(content) as sha256 from inv where doc_id % 4 <> 3 or {_HIT} union all select full_path, epoch_us(last_write_utc) - 1000000, sha256(content) from inv where doc_id % 4 = 3 and doc_id % 3 <> 0 and doc_id % 5 = 0")(
    lambda s, d: reuse.fingerprint_upsert(prior_snapshot(s, d), reuse.with_fingerprints(inventory(s, d).filter("doc_id % 4 <> 3"), prior_snapshot(s, d), sha256), F.timestamp_seconds(F.lit(1800000000)), 0).select("full_path", "mtime_us", "sha256")
)
query("fingerprint_stats", _INV + f"select count(*) filter (where {_HIT}) as hits, count(*) filter (where not ({_HIT})) as computes, count(*) filter (where doc_id % 3 <> 0 and doc_id % 5 = 0) as invalidations, greatest(count(*) - 200000, 0) as evictions, least(count(*), 200000) as entries from inv")(
    lambda s, d: reuse.fingerprint_stats(inventory(s, d), prior_snapshot(s, d))
)
query("latest_versions", _INV + "select full_path, epoch_us(last_write_utc) as mtime_us from inv where doc_id % 3 <> 0")(
    lambda s, d: reuse.latest_versions(prior_snapshot(s, d).unionByName(inventory(s, d).filter("doc_id % 3 <> 0 and doc_id % 5 = 0").select("full_path", "size_bytes", F.unix_micros("last_write_utc").alias("mtime_us"), sha256(F.col("content")).alias("sha256"), F.lit(None).cast("string").alias("quick_signature"), F.timestamp_seconds(F.lit(1)).alias("last_used")))).select("full_path", "mtime_us")
)
query("retention", _INV + "select full_path from inv where doc_id % 3 <> 0 order by doc_id desc, full_path limit 100")(lambda s, d: reuse.retain(prior_snapshot(s, d), 100).select("full_path"))


def _retained_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last used half of a snapshot whose rows share few times of use."""
    rows = prior_snapshot(spark, sf_dir).withColumn("last_used", F.expr("timestamp_seconds(mtime_us div 1000000 % 5)"))
    return reuse.retain(rows, rows.count() // 2).select("full_path")


query("retention_half", _INV + ", p as (select full_path, (epoch_us(last_write_utc) // 1000000 - case when doc_id % 5 = 0 then 1 else 0 end) % 5 as used from inv where doc_id % 3 <> 0) select full_path from (select full_path, row_number() over (order by used desc, full_path) as r from p) where r <= (select count(*) // 2 from p)")(_retained_half)

# ---- journal, undo, recovery -------------------------------------------------------------

_KIND = "case doc_id % 4 when 0 then 'copied' when 1 then 'moved' when 2 then 'quarantined_duplicate' else 'deleted_duplicate' end"
_TX = "concat('tx', doc_id % 7)"


def journal_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, journal_entries): seven runs whose actions end done, failed or pending by doc_id."""
    rows = inventory(spark, sf_dir).select("doc_id", "full_path", "last_write_utc", F.expr(_TX).alias("transaction_id"), F.expr(_KIND).alias("action"))
    planned = rows.select("transaction_id", F.col("doc_id").alias("seq"), "action", F.col("full_path").alias("source_path"), F.when(F.col("action") != "deleted_duplicate", F.concat(F.lit("/target"), "full_path")).alias("destination_path"), F.col("last_write_utc").alias("timestamp_utc"), (F.col("action") != "deleted_duplicate").alias("reversible"))
    nothing = F.lit(None).cast("string")
    pending = planned.withColumns({"event_no": F.lit(0).cast("long"), "status": F.lit("pending"), "error_message": nothing})
    ended = planned.filter("seq % 10 <> 1").withColumns({"event_no": F.lit(1).cast("long"), "status": F.when(F.col("seq") % 10 == 0, "failed").otherwise("done"), "error_message": F.when(F.col("seq") % 10 == 0, "denied").otherwise(nothing)})
    names = [f.split()[0] for f in journal.ENTRIES.split(", ")]
    entries = pending.select(*names).unionByName(ended.select(*names))
    states = {0: "completed", 1: "running", 2: "failed", 3: "cancelled", 4: "rolled_back", 5: "completed", 6: "running"}
    status = F.create_map(*[F.lit(v) for k, s in states.items() for v in (f"tx{k}", s)])[F.col("transaction_id")]
    heads = rows.groupBy("transaction_id").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    null = F.lit(None).cast("string")
    heads = heads.select("transaction_id", F.timestamp_seconds(F.lit(1700000000)).alias("created_at_utc"), F.lit("/lake").alias("source_root"), F.lit("/target").alias("target_root"), status.alias("lifecycle_status"), F.lit("organize").alias("checkpoint_stage"), F.col("n").alias("checkpoint_processed"), F.col("n").alias("checkpoint_total"), null.alias("checkpoint_message"), F.timestamp_seconds(1700000000 + F.col("last")).alias("updated_at_utc"), null.alias("interruption_reason"))
    return heads, entries


_JOURNAL = _with(
    _BASE,
    f"ent as (select {_TX} as transaction_id, doc_id as seq, {_KIND} as action, full_path as source_path, case when doc_id % 4 <> 3 then '/target' || full_path end as destination_path, case doc_id % 10 when 0 then 'failed' when 1 then 'pending' else 'done' end as status from inv)",
    "tx as (select transaction_id, (['completed','running','failed','cancelled','rolled_back','completed','running'])[cast(substr(transaction_id, 3) as int) + 1] as lifecycle_status, make_timestamp((1700000000 + max(seq)) * 1000000) as updated_at_utc, count(*) filter (where status <> 'done') as open_entries from ent group by 1)",
    "rec as (select * from tx where lifecycle_status <> 'rolled_back' and (lifecycle_status in ('running', 'failed', 'cancelled') or open_entries > 0))",
    "undo as (select *, row_number() over (partition by transaction_id order by seq desc) as step, case action when 'copied' then 'remove_destination' when 'deleted_duplicate' then 'cannot_restore' else 'restore_source' end as undo_action, case when action = 'deleted_duplicate' then concat('Deleted record cannot be restored (', source_path, ').') end as error from ent where status = 'done')",
)
query("journal_status", _JOURNAL + "select transaction_id, seq, action, source_path, status from ent")(lambda s, d: journal.current_entries(journal_tables(s, d)[1]).select("transaction_id", "seq", "action", "source_path", "status"))
query("undo_plan", _JOURNAL + "select transaction_id, step, seq, undo_action, action, source_path, destination_path, error from undo")(lambda s, d: journal.undo_plan(journal_tables(s, d)[1]))
query("undo_summary", _JOURNAL + "select count(*) filter (where action = 'copied') as files_copied, count(*) filter (where action = 'moved') as files_moved, count(*) filter (where action = 'quarantined_duplicate') as duplicates_quarantined, count(error) as n_errors from undo where transaction_id = 'tx1'")(
    lambda s, d: journal.undo_summary(journal.undo_plan(journal_tables(s, d)[1].filter("transaction_id = 'tx1'")))
)
query(
    "verify_rollback",
    _JOURNAL
    + """, loc as (select full_path from base where doc_id % 3 <> 0 union select '/target' || full_path from base where doc_id % 5 = 0),
chk as (select e.*, s.full_path is not null as st, t.full_path is not null as dt from ent e left join loc s on s.full_path = source_path left join loc t on t.full_path = destination_path where status = 'done')
select transaction_id, seq, concat('After undo a copy is left: ', destination_path) as issue from chk where action = 'copied' and dt
union all select transaction_id, seq, concat('After undo a record is missing: ', source_path) from chk where action in ('moved', 'quarantined_duplicate') and not st
union all select transaction_id, seq, concat('After undo a moved record is left: ', destination_path) from chk where action in ('moved', 'quarantined_duplicate') and dt""",
)(
    lambda s, d: journal.verify_rollback(
        journal_tables(s, d)[1],
        inventory(s, d).filter("doc_id % 3 <> 0").select("full_path").unionByName(inventory(s, d).filter("doc_id % 5 = 0").select(F.concat(F.lit("/target"), "full_path").alias("full_path"))),
    )
)
query("recoverable", _JOURNAL + "select transaction_id, lifecycle_status, open_entries, updated_at_utc from rec")(lambda s, d: journal.recoverable_transactions(*journal_tables(s, d)))
query("recover_all", _JOURNAL + "select r.transaction_id, count(*) filter (where action = 'copied') as files_copied, count(*) filter (where action = 'moved') as files_moved, count(*) filter (where action = 'quarantined_duplicate') as duplicates_quarantined, count(error) as n_errors from rec r left join undo u using (transaction_id) group by 1")(
    lambda s, d: journal.recover_all(*journal_tables(s, d))
)
query("recovery_summary", _JOURNAL + "select count(*) filter (where action = 'copied') as files_copied, count(*) filter (where action = 'moved') as files_moved, count(*) filter (where action = 'quarantined_duplicate') as duplicates_quarantined, count(error) as n_errors from rec r join undo u using (transaction_id)")(
    lambda s, d: journal.recovery_summary(journal.recover_all(*journal_tables(s, d)))
)
query("latest_transaction", _JOURNAL + "select transaction_id, lifecycle_status, updated_at_utc from tx order by updated_at_utc desc, transaction_id desc limit 1")(
    lambda s, d: journal.latest_transaction(journal_tables(s, d)[0]).select("transaction_id", "lifecycle_status", "updated_at_utc")
)
query("live_set", _JOURNAL + "select full_path, size_bytes from inv where full_path not in (select source_path from ent where status = 'done' and action <> 'copied' and transaction_id <> 'tx4')")(
    lambda s, d: journal.live_set(inventory(s, d), journal_tables(s, d)[1], journal_tables(s, d)[0]).select("full_path", "size_bytes")
)

# ---- reports -----------------------------------------------------------------------------


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir)
    actions = plan.action_summary(plan.dedupe_plan(rows, "quarantine", ROOT))
    return report.run_summary([source.scan_summary(inventory(spark, sf_dir)), dedupe.dedupe_summary(rows), actions], "2024-06-01 00:00:00 UTC", "/lake", TARGET, "tx0")


_METRICS = _MEM + """, g as (select size_bytes, count(*) as n from members group by sha256_hash, size_bytes),
v as (select (select count(*) from inv) as files, cast((select coalesce(sum(size_bytes), 0) from inv) as bigint) as bytes, count(*) as groups, cast(coalesce(sum(n - 1), 0) as bigint) as dup, cast(coalesce(sum(size_bytes * (n - 1)), 0) as bigint) as reclaim from g)"""
_VALUES = dict(zip(report.METRICS, ["'2024-06-01 00:00:00 UTC'", "'tx0'", "'/lake'", f"'{TARGET}'", "files", "bytes", "groups", "dup", "0", "0", "reclaim", "0", "0", "dup", "0", "0"], strict=True))
query("report_metrics", _METRICS + " union all ".join(f"select {i} as position, '{m}' as metric, cast({v} as varchar) as value from v" for i, (m, v) in enumerate(_VALUES.items(), start=1)))(lambda s, d: report.report_metrics(_summary(s, d)))
query("report_members", _MEM + "select sha256_hash, size_bytes, full_path from members")(lambda s, d: report.report_members(members(s, d)))
query(
    "report_digest",
    _METRICS
    + f""", top as (select sha256_hash, size_bytes, count(*) as n from members group by 1, 2 order by n desc, size_bytes desc, sha256_hash limit 10)
select line_no, line from (values (0, 'Run Report'), (1, 'Generated: 2024-06-01 00:00:00 UTC'), (2, 'Transaction ID: tx0'), (3, 'Source: /lake'), (4, 'Target: {TARGET}'), (9, 'Similar Image Groups: 0'), (10, 'Skipped Files: 0'), (12, 'Copied: 0'), (13, 'Moved: 0'), (15, 'Deleted: 0'), (16, 'Errors: 0'), (17, ''), (18, 'Top Duplicate Groups:')) t(line_no, line)
union all select 5, 'Total Files: ' || files from v union all select 6, 'Total Size: ' || {_size_text('bytes')} from v union all select 7, 'Duplicate Groups: ' || groups from v
union all select 8, 'Duplicate Files: ' || dup from v union all select 11, 'Reclaimable: ' || {_size_text('reclaim')} from v union all select 14, 'Quarantined: ' || dup from v
union all select 18 + row_number() over (order by n desc, size_bytes desc, sha256_hash), concat('- ', substr(sha256_hash, 1, 12), '... (', n, ' files, ', {_size_text('size_bytes')}, ')') from top""",
)(lambda s, d: report.report_digest(_summary(s, d), members(s, d)))


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's datasets, written and read back: counts of each section's rows."""
    folder = new_path(spark, "report")
    none = spark.createDataFrame([], "anchor_path string, full_path string, group_size long")
    rows = inventory(spark, sf_dir)
    skipped = rows.filter("doc_id % 17 = 0").select("full_path")
    errors = rows.filter("doc_id % 19 = 0").select(C.error_message("Could not read", F.col("full_path")).alias("message"))
    report.write_report(folder, _summary(spark, sf_dir), members(spark, sf_dir), none, skipped, errors)
    head = spark.read.json(f"{folder}/document").select("transaction_id", F.col("summary.total_files_scanned").alias("files"), F.col("summary.duplicate_group_count").alias("groups"))
    counts = {"members": spark.read.json(f"{folder}/duplicate_groups"), "csv_members": spark.read.csv(f"{folder}/members", header=True), "csv_skipped": spark.read.csv(f"{folder}/skipped", header=True)}
    counts["csv_errors"] = spark.read.csv(f"{folder}/errors", header=True, escape='"')
    for name, section in counts.items():
        head = head.withColumn("k", F.lit(1)).join(section.agg(F.count("*").alias(name), F.lit(1).alias("k")), "k").drop("k")  # one row each
    return head


query("report_document", _MEM + "select 'tx0' as transaction_id, (select count(*) from inv) as files, count(distinct sha256_hash || size_bytes) as groups, count(*) as members, count(*) as csv_members, (select count(*) from inv where doc_id % 17 = 0) as csv_skipped, (select count(*) from inv where doc_id % 19 = 0) as csv_errors from members")(_document)

# ---- streaming, generator ------------------------------------------------------------------


def _intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory taken in as a stream, in one pass over what is there."""
    folder = new_path(spark, "intake")
    inventory(spark, sf_dir).repartition("doc_id").write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    intake.incremental_intake(stream, f"{folder}/store", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return intake.read_intake(spark, f"{folder}/out").select("full_path", "sha256", "is_duplicate")


query("intake_stream", _INV + "select full_path, sha256(content) as sha256, row_number() over (partition by sha256(content) order by last_write_utc, lower(full_path), full_path) > 1 as is_duplicate from inv")(_intake)


def _stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "stream-filter")
    inventory(spark, sf_dir).drop("content").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    kept = intake.filter_stream(stream, _ALL, TARGET).select("full_path", "size_bytes", "destination")
    kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/out")


query("stream_filter_project", _INV + f"select full_path, size_bytes, concat('{TARGET}/', folder, '/', strftime(last_write_utc, '%Y/%m')) as destination from inv where {_FILTERS['filter_all'][1]}")(_stream_filter)


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic inventory as large as ``documents``, deduplicated: its answer is known from the ratios."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = dedupe.duplicate_members(synthetic_inventory(spark, n))
    return dedupe.dedupe_summary(rows).select("duplicate_group_count", "duplicate_files_found")


query("synthetic_inventory", "select floor(count(*) * 0.2)::bigint // 2 as duplicate_group_count, floor(count(*) * 0.2)::bigint // 2 as duplicate_files_found from documents")(_synthetic)
