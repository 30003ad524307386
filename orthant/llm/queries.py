"""The operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, linededup, mixing, neardup, pii, quality, substrings, tokens

TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> str:
    """The key of the session's surrogates. The one that stands in where none is set is public, so it serves
    for synthetic tables only."""
    return spark.conf.get("spark.orthant.surrogates.key", "synthetic-tables")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2  # null without an id: not learned from
    model = langid.train_on(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_decisions(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(read(spark, sf_dir, "documents"), surrogate_key(spark))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_language_id, op3_decontamination, op4_line_dedup, op5_token_output, op6_near_dedup, op7_pii_surrogates, op8_chat_format, op9_source_mix, op10_quality_rules)
    return {f.__name__: f for f in own}


OP4_SQL = r"""
with lines as (
  select doc_id, md5(coalesce(text, '')) as row_hash, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
common as (
  select key, max(doc_id) as holder from keyed
  where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*) as n_lines, count(*) filter (where c.key is not null and k.doc_id <> c.holder) as n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where c.key is null or k.doc_id = c.holder), '')) as kept_sha256
from keyed k left join common c on k.key = c.key
group by k.doc_id, k.row_hash
"""

OP8_SQL = """
with numbered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as n
  from conversations where conv_id is not null),
whole as (
  select conv_id, count(*) as n_turns, list({'role': role, 'text': text} order by n) as turns from numbered group by conv_id),
prefixes as (
  select distinct list_slice(turns, 1, k) as turns from (select turns, unnest(range(1, n_turns)) as k from whole)),
kept as (
  select min(conv_id) as conv_id, count(*) as n_same, n_turns, turns from whole
  where turns not in (select turns from prefixes) group by n_turns, turns)
select conv_id, n_turns, n_same,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' ||
         replace(replace(x.role, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || chr(10) ||
         replace(replace(x.text, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') || '<|im_end|>' || chr(10)), 'string_agg', '') as chat
from kept
"""

OP9_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
by_source as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (
  select *, case (place % 3) when 0 then 5 when 1 then 2 else 1 end as weight
  from (select source, source_size, row_number() over (order by encode(source) nulls last) - 1 as place from by_source)),
levels as (
  select *, sum(source_size) over () as total,
    (sum(source_size) over () - coalesce(sum(3 * source_size) over w, 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as room
  from placed
  window w as (order by source_size::double / weight, place rows between unbounded preceding and 1 preceding)),
level as (
  select coalesce((select room from levels where not (3 * source_size <= room * weight)
                   order by source_size::double / weight, place limit 1), 0) as per_weight),
goals as (
  select l.*, least((3 * source_size)::double, per_weight * weight) as target from levels l, level),
bounds as (
  select *, floor((upto - goal) / whole * 4294967296)::bigint as lo, floor(upto / whole * 4294967296)::bigint as hi
  from (select place, ((source_size + 31) // 32)::bigint as blocks, round(target)::bigint::double as goal,
               (sum(round(target)::bigint) over (order by place))::double as upto,
               (sum(round(target)::bigint) over ())::double as whole
        from goals where target > 0)),
slots as (
  select j, ((j * 2654435769) & 4294967295)::bigint as point
  from (select unnest(range(((select coalesce(max(total), 0) from goals)::bigint + 16) // 32)) as j)),
ranked as (
  select place, blocks, row_number() over (partition by place order by j) - 1 as r
  from slots join bounds on lo <= point and point < hi),
times as (select place, r % blocks as block, count(*) as times from ranked where r < 3 * blocks group by all),
laid as (
  select doc_id, size, source_size, target, place,
         (sum(size) over (partition by place order by md5('mix-1/' || coalesce(doc_id::varchar, '')), size
                          rows between unbounded preceding and current row) - size)::bigint as start
  from sized join goals on sized.source is not distinct from goals.source),
got as (
  select doc_id, start, place, sum((least(start + size, (block + 1) * 32) - greatest(start, block * 32)) * times) as taken
  from (select *, unnest(range(start // 32, (start + size - 1) // 32 + 1)) as block from laid where size > 0) join times using (place, block)
  group by all)
select l.doc_id, l.size, l.source_size, l.target, coalesce(case when l.size > 0 then g.taken end, 0)::bigint as taken
from laid l left join got g on l.place = g.place and l.start = g.start and l.size > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op8_chat_format": OP8_SQL, "op9_source_mix": OP9_SQL}
