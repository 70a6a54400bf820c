"""Registered queries of the training-data operators. Each reads its whole
table and derives the columns of its contract from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sqlkiln.llm import (
    chat, decontam, filter_audit, langid, merkle, mixing, ppm, quality_rules, sharding, simhash, token_files, toxicity,
    weak_quality,
)
from sqlkiln.llm.common import ascii_lower, fold, table
from sqlkiln.session import shared_dir


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("conv_id", "segment", "speaker", "n_turns", "context", "offset", "text", spans.alias("mask_spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "ratio", "first_word",
                        "last_word", "passage")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = weak_quality.score(docs, weak_quality.fit(docs))
    return found.select(F.col("id").alias("doc_id"), "score", "weak", "ballot", (F.col("score") >= 0.5).alias("kept"))


# Token shares of the label domains; the good documents stay as they are.
MIX_TARGETS = {"good": 0.90, "low": 0.05, "toxic": 0.05}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, fit = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX_TARGETS,
                              keep_whole="good")
    at = {n: i for i, n in enumerate(fit.domains)} if fit else {}
    shares = [(F.get("member", F.lit(at[n])) if n in at else F.lit(None).cast("double")).alias(f"p_{n}")
              for n in MIX_TARGETS]
    return found.select(F.col("id").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"), *shares, "rate",
                        "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(fold(F.col("doc_id"), 5) != 0), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "lang_pred",
                        "score", "n_letter_words", "n_switches")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), shards=16, slots=sharding.SLOTS)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 10) == 0).alias("held_out"), "n_tokens",
                        "n_known", "train_tokens", "base_score", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "stratum",
                        *[f"over_{r.name}" for r in quality_rules.RULES])


TOKENIZER = "byte_bpe_50k.json"


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    found = token_files.read_digests(spark, path)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest(*rest, F.col("text"))
    tampered = merkle.leaf_digest(*rest, ascii_lower(F.col("text")))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(hit, tampered).otherwise(leaf).alias("now"))
    found = merkle.verified(merkle.manifest(leaves, "source", ["doc_id"], "leaf", ("doc_id", "now")), "now")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root",
                        merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(table(spark, sf_dir, "documents"), filter_audit.quality_filters(F.col("text")))
    return filter_audit.audit(filter_audit.reduce_masks(failed, table(spark, sf_dir, "labels")), "ABCDE")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}


def _rules_sql() -> str:
    """The quality rules in SQL, from the same rule table: counts by splitting
    and unnesting windows, the binomial tail by ``lgamma``."""
    rules = quality_rules.RULES
    grid = ", ".join(f"('{r.name}', {j}, {c!r})" for r in rules for j, c in enumerate(r.cutoffs))
    value = " ".join(f"when '{r.name}' then {r.value}" for r in rules)
    level = f"{quality_rules.RISK} / {len(rules)}"
    over = ", ".join(f"coalesce({r.value} > max(cutoff) filter (where rule = '{r.name}'), false) as over_{r.name}" for r in rules)
    each = "rid, doc_id, stratum, n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines, n_repeat_words, base_failed"
    flags = ", ".join(f"over_{r.name}" for r in rules)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as t from documents),
w as (
    select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
    from d),
windows as (select rid, i, array_to_string(ws[i:i + 4], ' ') as k from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w)),
twice as (select rid, i from windows qualify count(*) over (partition by rid, k) > 1),
covered as (select rid, count(distinct i + j) as n from twice, range(5) as o(j) group by rid),
counts as (
    select w.rid, doc_id, stratum, len(ws) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '!')) as n_exclaims,
           len(ls) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
           coalesce(covered.n, 0) as n_repeat_words
    from w left join covered on w.rid = covered.rid),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts),
labelled as (select doc_id, min(quality) > 0 as good from labels where doc_id is not null and quality is not null group by doc_id),
held as (select judged.*, good from judged join labelled using (doc_id)),
grid(rule, nth, cutoff) as (values {grid}),
tested as (
    select stratum, rule, nth, cutoff, count(*) filter (where good and not base_failed) as good,
           count(*) filter (where not good and not base_failed) as bad,
           count(*) filter (where good and not base_failed and case rule {value} end > cutoff) as k,
           count(*) filter (where not good and not base_failed and case rule {value} end > cutoff) as hits
    from held, grid group by all),
scored as (
    select *, hits / greatest(bad, 1) - {quality_rules.GOOD_WEIGHT} * k / greatest(good, 1) as gain,
           case when good = 0 or k >= good * {level} then 1.0 else least(1.0, list_sum(list_transform(range(k + 1), lambda i:
               exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({level}) + (good - i) * ln(1 - {level}))))) end as p
    from tested),
stopped as (
    select *, min(nth) filter (where p > {quality_rules.ERROR} / ({len(rules)} * (select count(distinct stratum) from held)))
        over (partition by stratum, rule) as stop
    from scored),
chosen as (
    select stratum, rule, cutoff from stopped where (stop is null or nth < stop) and gain > 0
    qualify row_number() over (partition by stratum, rule order by gain desc, cutoff desc) = 1),
final as (select {each}, {over} from judged left join chosen using (stratum) group by {each})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not ({flags.replace(", ", " or ")}) as kept, stratum, {flags}
from final
"""


def _merkle_sql(fanout: int = merkle.FANOUT, heights: int = 8) -> str:
    """The Merkle manifest in SQL, one height after the other: ``u`` are the
    trees of the sources, ``v`` the tree of their roots. Eight heights are
    enough for 16^8 rows a source."""
    def digest(*fields: str) -> str:
        said = (f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in fields)
        return f"sha256({' || '.join(said)})"

    def tree(t: str) -> str:
        """Levels ``t1``, ``t2``, ... and, for every node that has siblings'
        room, the digests left and right of it."""
        return "".join(f"""
{t}r{k} as (
    select g, m, coalesce(string_agg(h, '') over (run rows between unbounded preceding and 1 preceding), '') as l,
           coalesce(string_agg(h, '') over (run rows between 1 following and unbounded following), '') as r
    from {t}{k} where n > 1 window run as (partition by g, m // {fanout} order by m)),
{t}{k + 1} as (
    select *, count(*) over (partition by g) as n from (
        select g, m // {fanout} as m, sha256(string_agg(h, '' order by m)) as h from {t}{k} where n > 1 group by all
        union all select g, m, h from {t}{k} where n = 1)),""" for k in range(heights))

    def walk(t: str, start: str, name: str) -> str:
        """Append every height's siblings to the proof and fold the digest."""
        return "".join(f"""
{name}{k + 1} as (
    select a.* replace (proof || coalesce(l || r, '') as proof, case when l is null then f else sha256(l || f || r) end as f)
    from {start if k == 0 else f"{name}{k}"} a left join {t}r{k} b on b.g = {"a.g" if t == "u" else "''"} and a.{t}m // {fanout**k} = b.m),"""
                       for k in range(heights))

    byte = "xor(c, cast(unicode(d) as bigint))"
    bit = "case when x & 1 = 1 then xor(x >> 1, cast(3988292384 as bigint)) else x >> 1 end"
    crc = f"""xor(4294967295, list_reduce(string_split(cast(doc_id as varchar), ''), lambda c, d:
        list_reduce(list_concat([{byte}], range(8)), lambda x, i: {bit}), cast(4294967295 as bigint)))"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = ("doc_id", "source", "lang", "n_chars")
    return f"""
with leaves as (
    select doc_id, coalesce('_' || source, '') as g, {digest(*rest, "text")} as h,
           case when {crc} % 5 = 0 then {digest(*rest, lower)} else {digest(*rest, "text")} end as now
    from documents),
u0 as (
    select *, row_number() over (partition by g order by doc_id nulls first, h, now) - 1 as m, count(*) over (partition by g) as n
    from leaves),{tree("u")}
v0 as (select '' as g, g as of, h, row_number() over (order by g) - 1 as m, count(*) over () as n from u{heights}),{tree("v")}
a0 as (
    select doc_id, u0.g, u0.h as leaf, u0.now as f, '' as proof, u0.m as um, v0.m as vm, v0.h as subroot
    from u0 join v0 on u0.g = v0.of),{walk("u", "a0", "a")}{walk("v", f"a{heights}", "b")}
top as (select h as root from v{heights})
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified
from b{heights}, top
"""


ORACLE: dict[str, str] = {
    "op12_merkle_manifest": _merkle_sql(),
    "op13_filter_audit": r"""
with d as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
    from documents),
failed as (
    select doc_id, part, cast(len(ws) < 50 as int) + 2 * cast(100 * len(list_distinct(ws)) < 65 * len(ws) as int)
           + 4 * cast(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) as int)
           + 8 * cast(regexp_matches(t, '[#$%&*|]') as int)
           + 16 * cast(coalesce(min(doc_id) over (partition by t) < doc_id, false) as int) as mask
    from d),
marks as (select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id),
sums as (
    select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
    from failed left join marks using (doc_id) group by part, mask),
letters(c, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
    select a.c || b.c || c.c || d.c || e.c as filter_order
    from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
    select filter_order, step, bit, (select coalesce(sum(l.bit), 0) from letters l where position(l.c in filter_order) < step) as before
    from orders, range(1, 6) as s(step), letters where c = filter_order[step]),
counted as (
    select part, filter_order, step, bit,
           coalesce(sum(n) filter (where mask & (cast(before as int) | bit) = 0), 0) as kept,
           coalesce(sum(n) filter (where mask & bit > 0 and mask & cast(before as int) = 0), 0) as removed,
           coalesce(sum(n) filter (where mask & bit > 0 and mask & cast(before as int) > 0), 0) as redundant,
           coalesce(sum(n) filter (where mask = bit), 0) as unique_fails,
           coalesce(sum(good) filter (where mask & bit > 0 and mask & cast(before as int) = 0), 0) as good_lost,
           coalesce(sum(toxic) filter (where mask & bit > 0 and mask & cast(before as int) = 0), 0) as toxic_lost
    from sums, steps group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from counted
""",
    "op10_quality_rules": _rules_sql(),
    "op2_chat_formatting": f"""
with known as (
    select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as said from conversations),
rows as (select distinct * from known where turn is not null union all select * from known where turn is null),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, said) as nth from rows),
sized as (
    select *, length('<|im_start|>' || case when role = 'system' then 'system' else 'user name=' || role end || chr(10)
                     || said || '<|im_end|>' || chr(10)) as size from numbered),
cut as (select *, cast(floor((sum(size) over (partition by conv_id order by nth) - size) / {chat.SEGMENT_CHARS}) as bigint) as segment from sized),
speakers as (select distinct conv_id, role as speaker from rows where role <> 'system'),
pieces as (
    select r.conv_id, r.segment, s.speaker, r.nth, r.role, r.said, r.role = s.speaker as own,
           '<|im_start|>' || case when r.role = s.speaker then 'assistant' when r.role = 'system' then 'system'
               else 'user name=' || r.role end || chr(10) as head,
           r.said || '<|im_end|>' || chr(10) as tail
    from cut r join speakers s on r.conv_id is not distinct from s.conv_id),
placed as (
    select *, sum(length(head) + length(tail)) over (partition by conv_id, speaker order by nth) as ends from pieces),
told as (
    select conv_id, segment, '<|im_start|>system' || chr(10) || said || '<|im_end|>' || chr(10) as context
    from cut where role = 'system' qualify row_number() over (partition by conv_id order by nth) = 1),
whole as (
    select conv_id, segment, speaker, count(*) as n_turns, cast(min(ends - length(head) - length(tail)) as bigint) as "offset",
           string_agg(head || tail, '' order by nth) as text,
           coalesce(string_agg((ends - length(tail)) || '-' || ends, ',' order by nth) filter (where own), '') as mask_spans
    from placed group by conv_id, segment, speaker)
select whole.*, case when told.segment < whole.segment then context else '' end as context
from whole left join told on whole.conv_id is not distinct from told.conv_id
""",
}
