"""Registered queries of the operators, with the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from shelfmark.llm import chat, decontamination, dedup, language, merkle, mixing, ppm, quality, repair, repeats, rollup, secrets, tiff
from shelfmark.llm.common import append, read, remainder, saved, utf8
from shelfmark.session import scratch_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    held = remainder("doc_id", 4) == 2
    model = language.fit(docs.filter(~held))
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
MARKS_SQL = r"coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')), 0)"
LINKS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]*://[^\x20\x09-\x0D]*')), 0)"

OP2_SQL = f"""with net as (
select source, lang, {WORDS_SQL} - {LINKS_SQL} as words, {MARKS_SQL} as marks from documents
where doc_id is null or doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null))
select source, lang, 'words-1' as tokenizer, cast(count(*) as bigint) as docs, cast(sum(words) as bigint) as tokens from net group by source, lang
union all select source, lang, 'marks-1', cast(count(*) as bigint), cast(sum(marks) as bigint) from net group by source, lang"""


@query("op2_token_counts", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts of all documents under two tokenizers, revised counts without links, deletes of toxic documents, and
    every batch sent a second time."""

    def matches(pattern):
        return F.coalesce(F.regexp_count(F.col("text"), F.lit(pattern)), F.lit(0)).cast("long")

    words, marks = matches(mixing.WORD), matches(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")
    links = matches(r"[^\x20\x09-\x0D]*://[^\x20\x09-\x0D]*")
    docs = read(spark, sf, "documents")
    docs = saved(docs.select("doc_id", "source", "lang", words.alias("words"), marks.alias("marks"), links.alias("links")), "counts")
    first, clean = F.col("words"), F.col("words") - F.col("links")

    def of(name, tokens):
        return rollup.image(F.col("source"), F.col("lang"), F.lit(name), tokens)

    def change(old, new):
        return F.struct(old.alias("old"), new.alias("new"))

    none = rollup.no_image()
    inserts = docs.select(F.inline(F.array(change(none, of("words-1", first)), change(none, of("marks-1", F.col("marks"))))))
    revised = docs.filter("links > 0").select(change(of("words-1", first), of("words-1", clean)).alias("c")).select("c.*")
    toxic = read(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    deleted = docs.join(toxic, "doc_id", "left_semi")
    deletes = deleted.select(F.inline(F.array(change(of("words-1", clean), none), change(of("marks-1", F.col("marks")), none))))
    table = rollup.Rollup(spark, scratch_path(spark, "rollup")).create()
    for _ in range(2):
        for name, changes in (("load", inserts), ("links", revised), ("toxic", deletes)):
            table.commit(name, changes)
    return table.totals()


# compression, predictor and tile size of a stored text, by its checksum: equal texts are stored alike
LAYOUTS = (("deflate", 1, None), ("lzw", 1, None), ("packbits", 1, None), ("deflate", 2, (64, 64)))


@query("op3_tiff")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")

    def stored():
        import zlib

        import numpy as np
        import pyarrow as pa

        def run(piece):
            sizes, files = [], []
            for data in utf8(piece, "text"):
                sizes.append(len(data))
                padded = data + b"\0" * (-len(data) % 64 if data else 64)
                compression, predictor, tile = LAYOUTS[zlib.crc32(padded) % len(LAYOUTS)]
                files.append(tiff.write_image([np.frombuffer(padded, np.uint8).reshape(-1, 64)], compression, predictor, tile=tile))
            return [pa.array(sizes, pa.int64()), pa.array(files, pa.binary())]

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    files = append(docs, fields, stored, "text", ["doc_id"])
    files = files.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pages = tiff.explode_pages(files)
    pixels = F.col("pixels")
    tail = F.expr("substring(pixels, length(pixels) - 63, 64)")
    return pages.select(
        "doc_id", "n_bytes", F.length(pixels).cast("long").alias("payload_bytes"), F.sha2(pixels, 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


@query("op4_ppm")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    held = remainder("doc_id", 10) == 0
    scored = ppm.score(read(spark, sf, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_near_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf, "documents"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op7_secrets")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Owners are sources, repositories the languages of a source."""
    found = secrets.scan_secrets(read(spark, sf, "documents"), F.col("source"), secrets.name(F.col("source"), F.col("lang")))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    copied = F.size(F.filter("spans", lambda s: s["copied"])).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.listed(F.col("spans")).alias("spans"), live.alias("n_live"), copied.alias("n_copied"))


@query("op8_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = read(spark, sf, "documents"), remainder("doc_id", 3) == 1
    weights = quality.fit(docs, read(spark, sf, "labels"), ~held)
    return quality.score(docs, weights, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


OP9_SQL = rf"""with d as (
select doc_id, source, cast({WORDS_SQL} as bigint) as size, cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as k
from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select source, source_size, 2.0::double * source_size as most, row_number() over (order by source nulls last) - 1 as i from s),
v as (select *, (case i % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w from w),
-- capped sources are those with the least most / w: the level that leaves the rest uncapped
c as (select *, coalesce(sum(most) over (order by most / w, i rows between unbounded preceding and 1 preceding), 0)::double as below,
      sum(w) over (order by most / w, i rows between current row and unbounded following)::double as open from v),
l as (select max((1.5::double * (select sum(source_size) from s) - below) / open) as level from c
      where (1.5::double * (select sum(source_size) from s) - below) / open <= most / w),
t as (select source, source_size, least(most, w * coalesce((select level from l), 1e300)) as target from v),
b as (select *, least(cast(round(target) as bigint), 2 * source_size) as budget from t),
p as (select d.doc_id, d.source, d.size, b.source_size, b.target, b.budget,
      coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join b on d.source is not distinct from b.source)
select doc_id, source, size, source_size, target,
  cast(case when source_size = 0 then 0 else (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) end as bigint) as taken
from p"""


@query("op9_mixing", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents"))


OP10_SQL = r"""with c as (
select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as last,
      lead(role) over (partition by conv_id order by turn nulls first, role, text) as following,
      row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
  case role when 'system' then 'System' when 'user' then 'User' when 'assistant' then 'Assistant'
  else '@' || replace(replace(replace(replace(role, '\', '\0'), '### ', '\1'), '</turn>', '\2'), ': ', '\3') end as label,
  replace(replace(replace(text, '\', '\0'), '### ', '\1'), '</turn>', '\2') as body from c)
select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by i), '')) as loss_sha256,
  cast(sum(length('### ' || label || ': ' || body || '</turn>' || chr(10))) as bigint) as formatted_chars,
  bool_and((last is null and role in ('system', 'user') or last is not null and (role = 'user' and last in ('system', 'assistant') or role = 'assistant' and last = 'user'))
    and (following is not null or role = 'assistant')) as valid
from o group by conv_id"""


@query("op10_chat", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(rows)
    # the hashes are of what is read back from the output
    turns = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("segments"))
    return done.select(
        "conv_id", "n_turns", F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


CRC_SQL = """crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as bytes)"""


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text, with the table of CRC_SQL in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1])), 4294967295)"


OP12_SQL = """with h as (select doc_id, row_number() over () as row, hex(encode(coalesce(text, ''))) as x from documents),
-- pieces of 1000 strings keep substr from walking through long texts
q as (select row, doc_id, base, substr(x, 2 * base + 1, 2098) as y from (select row, doc_id, x, unnest(range(0, greatest(length(x) // 2 - 49, 0), 1000)) as base from h)),
w as (select row, doc_id, base + i as p, substr(y, 2 * i + 1, 100) as g from (select row, doc_id, base, y, unnest(range(length(y) // 2 - 49)) as i from q)),
m as (select g, min(doc_id) as least from w group by g),
c as (select row, p, lag(p) over (partition by row order by p) as before from w join m using (g) where least < doc_id),
i as (select row, p, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by row order by p) as island from c),
s as (select row, min(p) as low, max(p) + 50 as high from i group by row, island),
k as (select h.row, h.x, low, high, lag(high) over (partition by h.row order by low) as last, lead(low) over (partition by h.row order by low) as following from h join s on h.row = s.row),
j as (select row, sum(high - low) as removed, count(*) as spans, string_agg(substr(x, 2 * coalesce(last, 0) + 1, 2 * (low - coalesce(last, 0))), '' order by low)
      || max(case when following is null then substr(x, 2 * high + 1) end) as kept from k group by row)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256
from h left join j on h.row = j.row"""


@query("op12_repeats", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    done = repeats.remove_repeats(read(spark, sf, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return done.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


OP11_SQL = rf"""with recursive {CRC_SQL},
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fault from conversations cross join crc),
g as (select conv_id, turn, case fault when 4 then 'user' else role end as role,
  case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
  unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) as copy from k),
o as (select *, left(role, 1) as initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as body,
  row_number() over w as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
  lag(left(role, 1)) over w as last from g window w as (partition by conv_id order by turn nulls first, role, text, copy)),
f as (select *, case when body = '' then 'blank' when seen > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (last is not null and last || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from f group by conv_id),
-- the least (cost, audit, repaired) per state: 1 nothing, 2 system, 3 user, 4 assistant; a user turn leads to 3 from all but 3
b(conv_id, i, p) as (
  select conv_id, 0, [struct_pack(c := 0, a := '', t := ''), struct_pack(c := 999999, a := '', t := ''), struct_pack(c := 999999, a := '', t := ''), struct_pack(c := 999999, a := '', t := '')] from c
  union all select conv_id, i, [{{drop1}}, least({{drop2}}, {{keep_s}}), {{to_user}}, {{to_assistant}}] from (
    select f.conv_id, f.i, role, text, initial, fault in ('blank', 'duplicate') as must, case fault when 'truncated' then 3 else 0 end as extra, p,
      [p[1], p[2], least(p[3], {{ins_user}}), least(p[4], {{ins_assistant}})] as q from b join f on b.conv_id is not distinct from f.conv_id and f.i = b.i + 1)),
e as (select c.conv_id, least(p[1], p[4], struct_pack(c := p[3].c + 3, a := p[3].a || 'I', t := p[3].t || 'assistant:' || chr(10)),
  struct_pack(c := p[2].c + 6, a := p[2].a || 'II', t := p[2].t || 'user:' || chr(10) || 'assistant:' || chr(10))) as best
  from b join c on b.conv_id is not distinct from c.conv_id and b.i = c.n)
select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit,
  sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join c on d.conv_id is not distinct from c.conv_id left join e on d.conv_id is not distinct from e.conv_id"""


def _state(cost: str, of: str, letter: str, turn: str) -> str:
    return f"struct_pack(c := {of}.c + {cost}, a := {of}.a || '{letter}', t := {of}.t || {turn})"


def _to(name: str, sources: tuple[int, ...], same: int) -> str:
    """The ways into a user or assistant state: kept, given a new role, or by deleting a row in the state."""
    ways = [_state("4", f"q[{same}]", "D", "''")]
    for s in sources:
        ways.append(f"case when must or initial != '{name[0]}' then struct_pack(c := 999999, a := '', t := '') else {_state('extra', f'q[{s}]', 'K', 'role || chr(58) || text || chr(10)')} end")
        ways.append(f"case when must then struct_pack(c := 999999, a := '', t := '') else {_state('3 + extra', f'q[{s}]', 'R', f"'{name}:' || text || chr(10)")} end")
    return f"least({', '.join(ways)})"


def _inserted(name: str, sources: tuple[int, ...]) -> str:
    ways = [_state("3", f"p[{s}]", "I", f"'{name}:' || chr(10)") for s in sources]
    return f"least({', '.join(ways)})"


OP11_SQL = OP11_SQL.format(
    drop1=_state("4", "q[1]", "D", "''"), drop2=_state("4", "q[2]", "D", "''"),
    keep_s=f"case when must or initial != 's' then struct_pack(c := 999999, a := '', t := '') else {_state('extra', 'q[1]', 'K', 'role || chr(58) || text || chr(10)')} end",
    to_user=_to("user", (1, 2, 4), 3), to_assistant=_to("assistant", (3,), 4),
    ins_user=_inserted("user", (1, 2, 4)), ins_assistant=_inserted("assistant", (3,)),
)


@query("op11_conversation_repair", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return repair.op_columns(rows, repair.repair(repair.damage(rows)))


LEAF_SQL = "sha256({doc} || {source} || {lang} || {chars} || {text})"
OP13_SQL = f"""with recursive {CRC_SQL},
d as (select doc_id, lang, n_chars, {LEAF_SQL.format(doc=field_sql("doc_id"), source=field_sql("source"), lang=field_sql("lang"), chars=field_sql("n_chars"), text=field_sql("text"))} as leaf,
  {LEAF_SQL.format(doc=field_sql("doc_id"), source=field_sql("source"), lang=field_sql("lang"), chars=field_sql("(n_chars + 1)"), text=field_sql("text"))} as other from documents),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank from d),
-- the lists of digests of each level; level by level until one is left
t(lang, level, nodes) as (
  select lang, 0, list(leaf order by rank) from r group by lang
  union all select lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from t where len(nodes) > 1),
s as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as rank from t where len(nodes) = 1),
u(level, nodes) as (
  select 0, list(subroot order by rank) from s having count(*) > 0
  union all select level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from u where len(nodes) > 1),
-- siblings: at each level the neighbour, if there is one
p as (select r.lang, r.rank, list(struct_pack(l := case when (r.rank >> t.level) % 2 = 1 then t.nodes[(r.rank >> t.level)] else '' end,
      r := case when (r.rank >> t.level) % 2 = 0 then coalesce(t.nodes[(r.rank >> t.level) + 2], '') else '' end) order by t.level) filter (len(t.nodes) > 1) as path
      from r join t on r.lang is not distinct from t.lang group by r.lang, r.rank),
q as (select s.lang, s.subroot, list(struct_pack(l := case when (s.rank >> u.level) % 2 = 1 then u.nodes[(s.rank >> u.level)] else '' end,
      r := case when (s.rank >> u.level) % 2 = 0 then coalesce(u.nodes[(s.rank >> u.level) + 2], '') else '' end) order by u.level) filter (len(u.nodes) > 1) as path
      from s cross join u group by s.lang, s.subroot),
w as (select r.doc_id, r.leaf, q.subroot, (select nodes[1] from u where len(nodes) = 1) as root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) as path,
  case when r.n_chars is not null and r.doc_id is not null and ({crc_sql("r.doc_id::varchar")}) % 7 = 0 then r.other else r.leaf end as now
  from r join p on r.lang is not distinct from p.lang and r.rank = p.rank join q on r.lang is not distinct from q.lang cross join crc),
x as (select *, list_reduce(list_prepend(now, list_transform(path, lambda e: e.l || '|' || e.r)), lambda own, e: sha256(split_part(e, '|', 1) || own || split_part(e, '|', 2))) as folded_root from w)
select doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(path, lambda e: e.l || e.r)), lambda a, b: a || b)) as proof_sha256,
  folded_root, folded_root = root as verified from x"""


@query("op13_merkle", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves are the rows; one in seven is tampered with after the manifest is made, and checked by its proof."""
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.digest(*[merkle.field(F.col(c)) for c in fields])
    changed = merkle.digest(*[merkle.field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in fields])
    tampered = F.col("doc_id").isNotNull() & F.col("n_chars").isNotNull() & (remainder("doc_id", 7) == 0)
    now = F.when(tampered, changed)
    done = merkle.manifest(docs, "lang", ["doc_id"], leaf, F.struct("doc_id", now.alias("now")))
    done = done.withColumn("folded_root", merkle.folded(F.coalesce("payload.now", "leaf"), F.col("path")))
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    return done.select("payload.doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
