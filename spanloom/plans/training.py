"""Queries of judging, sampling and token sequences, over judged_records and the files they point at."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import backends, judge, sampling, sequences
from spanloom.plans.sql import draw, lit
from spanloom.sources.parquet import table


def _spans(spark, sf_dir):
    return sampling.distinct_spans(table(spark, sf_dir, "judged_records"))


def _files(spark, sf_dir):
    return table(spark, sf_dir, "code_files").select(F.col("fileId").alias("id"), "content").filter("content is not null").dropDuplicates(["id"])


def _records(spark, sf_dir):
    by = table(spark, sf_dir, "judged_records").groupBy(*sampling.KEY, "piiType", "value").agg(F.min("detectedBy").alias("detectedBy"))
    return by.join(_files(spark, sf_dir), "id")


def context_windows(spark, sf_dir):
    return judge.contexts(_records(spark, sf_dir)).select(*sampling.KEY, "piiType", F.length("context").alias("n"), F.md5("context").alias("context_md5"))


def prompt_cache_keys(spark, sf_dir):
    return judge.prompts(_records(spark, sf_dir)).select(*sampling.KEY, "piiType", "cache_key")


def cache_lookup(spark, sf_dir):
    """Every other answer is stored; passwords are judged anew."""
    asked = judge.prompts(_records(spark, sf_dir))
    stored = asked.filter("id % 2 = 0").select("cache_key", F.lit(90).alias("score"), F.lit("stored").alias("reason"))
    found = judge.with_cache(asked, stored, ("password",))
    return found.groupBy("piiType").agg(F.count("*").alias("n"), F.count("cached_score").alias("n_hits"))


def _answers(spark, sf_dir):
    """Answers of all shapes, made from the stored scores and reasons."""
    rows = table(spark, sf_dir, "judged_records").select("id", "location_start", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("reason", F.lit("none")).alias("reason")).distinct()
    body = F.concat(F.lit('{"score": '), F.col("score").cast("string"), F.lit(', "reason": "'), F.translate("reason", '"\\', "''"), F.lit('"}'))
    shape = F.when(F.expr("id % 4 = 0"), body).when(F.expr("id % 4 = 1"), F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
    shape = shape.when(F.expr("id % 4 = 2"), F.concat(F.lit("I think "), body, F.lit(" fits"))).otherwise(F.concat(F.lit("no idea "), F.col("reason")))
    return rows.withColumn("answer", shape)


def parse_judge_json(spark, sf_dir):
    parsed = judge.parse_answer(F.col("answer"))
    return _answers(spark, sf_dir).select("id", "location_start", parsed["score"].alias("parsed_score"), parsed["reason"].alias("parsed_reason")).distinct()


def refine_fold(spark, sf_dir):
    records = _records(spark, sf_dir)
    return judge.fold(records.filter(judge.in_place(records))).select("id", "piiType", "location_start", "location_end", "score", "above")


def judge_counters(spark, sf_dir):
    records = _records(spark, sf_dir)
    return judge.counters(records, judge.fold(records.filter(judge.in_place(records))))


def prefiltered_spans(spark, sf_dir):
    return judge.prefiltered(_records(spark, sf_dir)).groupBy("piiType").agg(F.count("*").alias("n"))


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_spans(spark, sf_dir), 40, 10)


def one_per_file(spark, sf_dir):
    return sampling.one_per_file(_spans(spark, sf_dir), 1530)


def ratio_split(spark, sf_dir):
    return sampling.ratio_split(_spans(spark, sf_dir))


def enrich_samples(spark, sf_dir):
    return sampling.enrich(_spans(spark, sf_dir), table(spark, sf_dir, "code_files")).select(*sampling.KEY, "piiType", "value", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def duplicate_spans(spark, sf_dir):
    return sampling.duplicates(table(spark, sf_dir, "judged_records"))


def _tokens(spark, sf_dir):
    return sequences.tokenize(_files(spark, sf_dir), ["id"], "content")


def _shown(ids="input_ids"):
    return [F.size(ids).alias("n"), F.md5(F.array_join(ids, ",")).alias("ids_md5")]


def tokenize_files(spark, sf_dir):
    return _tokens(spark, sf_dir).select("id", *_shown())


def fim_transform(spark, sf_dir):
    return _tokens(spark, sf_dir).withColumn("input_ids", sequences.fim(F.col("input_ids"), F.col("id"))).select("id", *_shown())


def fim_older_order(spark, sf_dir):
    made = sequences.fim(F.col("input_ids"), F.col("id"), rate=1.0, spm_rate=1.0, spm_style="prefix-mark-first")
    return _tokens(spark, sf_dir).withColumn("input_ids", made).select("id", *_shown())


def _packed(batch_rows):
    def query(spark, sf_dir):
        return sequences.pack(_tokens(spark, sf_dir), ["id"], 1024, batch_rows).select("batch", "block", *_shown())

    return query


def span_parts(spark, sf_dir):
    parts = sequences.split_at_span(_spans(spark, sf_dir).join(_files(spark, sf_dir), "id"), "content")
    return parts.select(*sampling.KEY, "piiType", "value", F.length("prefix").alias("n_prefix"), F.md5("middle").alias("middle_md5"), F.length("suffix").alias("n_suffix"))


PROMPT_KEY = [*sampling.KEY, "piiType", "value"]


def _prompts(missing):
    def query(spark, sf_dir):
        parts = sequences.split_at_span(_spans(spark, sf_dir).join(_files(spark, sf_dir), "id"), "content")
        ids = parts.select(*PROMPT_KEY, *[sequences.hash_tokens(F.col(c)).alias(f"{c}_ids") for c in ("prefix", "middle", "suffix")])
        return sequences.prompts(ids, PROMPT_KEY, 256, missing).select(*PROMPT_KEY, "middle_start", *_shown())

    return query


def pad_batches(spark, sf_dir):
    padded = sequences.pad(sequences.batches(_tokens(spark, sf_dir), ["id"], 32))
    masked = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    ignored = F.size(F.filter("labels", lambda x: x == sequences.PAD_LABEL))
    return padded.select("id", "batch", F.size("input_ids").alias("n"), masked.alias("n_masked"), ignored.alias("n_ignored"))


def simulated_predictions(spark, sf_dir):
    """The model backend over the tokens of each span's value."""
    ids = _spans(spark, sf_dir).withColumn("expected", sequences.hash_tokens(F.col("value")))
    made = backends.simulate(ids, PROMPT_KEY, "expected")
    right = F.size(F.filter(F.zip_with("expected", "predicted_ids", lambda a, b: a == b), lambda x: x))
    return made.select(*PROMPT_KEY, F.size("expected").alias("n"), right.alias("n_right"), F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 5).alias("sum_probs"))


QUERIES = {f.__name__: f for f in (
    simulated_predictions, context_windows, prompt_cache_keys, cache_lookup, parse_judge_json, refine_fold, judge_counters, prefiltered_spans, stratified_split, one_per_file, ratio_split,
    enrich_samples, duplicate_spans, tokenize_files, fim_transform, fim_older_order, span_parts, pad_batches,
)}
QUERIES |= {"pack_blocks_batch": _packed(1000), "pack_blocks": _packed(None), "dynamic_prompts": _prompts(None), "attack_prompts": _prompts(50)}


def key(*columns: str) -> str:
    return "concat_ws(':', " + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in columns) + ")"


SPAN_KEY = "id, location_start, location_end"
FILES = "texts AS (SELECT DISTINCT fileId AS id, content FROM code_files WHERE content IS NOT NULL)"
SPANS = f'spans AS (SELECT {SPAN_KEY}, piiType, "value", max(score) AS score FROM judged_records GROUP BY ALL)'
RECORDS = f'records AS (SELECT j.*, t.content FROM (SELECT {SPAN_KEY}, piiType, "value", min(detectedBy) AS detectedBy FROM judged_records GROUP BY ALL) j JOIN texts t ON t.id = j.id)'
CONTEXT = "substr(content, greatest(location_start - 500, 0) + 1, least(location_end + 500, length(content)) - greatest(location_start - 500, 0))"
CONTEXTS = f"contexts AS (SELECT *, CASE WHEN piiType IN ({', '.join(map(lit, judge.ORDER))}) THEN {CONTEXT} ELSE substr(content, greatest(location_start, 0) + 1, least(location_end, length(content)) - greatest(location_start, 0)) END AS context FROM records)"
BASE = f"WITH {FILES}, {RECORDS}, {CONTEXTS}"
RUBRICS = "CASE piiType " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in judge.RUBRIC.items()) + " ELSE '' END"
CACHE_KEY = f"""md5(concat_ws(':', 'judge', {RUBRICS} || {lit(' ' + judge.ANSWER)}, 'Type: ' || piiType || chr(10) || 'Value: ' || "value" || chr(10) || 'Context:' || chr(10) || context, '0.0'))"""
IN_PLACE = 'substr(content, location_start + 1, greatest(location_end - location_start, 0)) = "value"'
ENTROPY = """coalesce(list_sum(list_transform(list_distinct(string_split("value", '')), lambda ch: -((length("value") - length(replace("value", ch, ''))) / length("value")::DOUBLE) * log2((length("value") - length(replace("value", ch, ''))) / length("value")::DOUBLE))), 0.0)"""
SIGNS = " OR ".join(f"piiType = {lit(k)} AND regexp_matches(lower(context), {lit(v)})" for k, v in judge.SIGNS.items())
THRESHOLDS = "CASE piiType " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in judge.THRESHOLD.items()) + " END"
JUDGED = f"""placed AS (SELECT * FROM contexts WHERE {IN_PLACE}), scored AS (SELECT *, 50 + 25 * ({SIGNS})::INTEGER + 15 * (({ENTROPY}) >= 2.5)::INTEGER + 10 * (length("value") >= 8)::INTEGER AS score,
    CASE WHEN piiType = 'key' AND detectedBy <> 'regex' THEN 'f' ELSE '0' END || md5({key('id', 'location_start', 'location_end', '"value"')} || ':42') AS o FROM placed),
    judged AS (SELECT *, (score >= {THRESHOLDS})::INTEGER AS above FROM scored)"""


def fold_sql() -> str:
    parts, used = [], "SELECT NULL::BIGINT AS id WHERE false"
    for n, kind in enumerate(judge.ORDER):
        parts.append(f"""f{n}a AS (SELECT *, coalesce(max(above) OVER (PARTITION BY id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM judged WHERE piiType = {lit(kind)} AND id NOT IN ({used})),
            f{n}b AS (SELECT *, sum(above) OVER (ORDER BY o) - above AS before FROM f{n}a WHERE seen = 0), f{n} AS (SELECT * FROM f{n}b WHERE before < {judge.ENOUGH})""")
        used += f" UNION SELECT id FROM f{n} WHERE above = 1"
    return ", ".join(parts) + ", folded AS (" + " UNION ALL ".join(f"SELECT id, piiType, location_start, location_end, score, above FROM f{n}" for n in range(len(judge.ORDER))) + ")"


FULL_KEY = key("id", "location_start", "location_end", "piiType", '"value"')
TOKENS = "list_transform(regexp_extract_all({t}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000)"
TOKENIZED = f"{FILES}, tokens AS (SELECT id, {TOKENS.format(t='content')} AS ids FROM texts)"
SHOWN = "len(ids) AS n, md5(array_to_string(ids, ',')) AS ids_md5"


def d(name: str, own: str) -> str:
    return draw(f"{own} || ':{name}'")


def fim_sql(rate: float, spm_rate: float, spm: str) -> str:
    own = "id::VARCHAR"
    return f"""WITH {TOKENIZED}, cuts AS (SELECT *, floor({d('cut1', own)} * (len(ids) + 1))::BIGINT AS u, floor({d('cut2', own)} * (len(ids) + 1))::BIGINT AS v FROM tokens),
        ab AS (SELECT *, least(u, v) AS a, greatest(u, v) AS b FROM cuts), parts AS (SELECT *, ids[1:a] AS pre, ids[a + 1:b] AS mid, ids[b + 1:greatest(len(ids) - 3, b)] AS suf FROM ab),
        made AS (SELECT id, CASE WHEN {d('fim', own)} < {rate} THEN CASE WHEN {d('spm', own)} < {spm_rate} THEN {spm} ELSE list_concat([50000], pre, [50001], suf, [50002], mid) END ELSE ids END AS ids FROM parts)
        SELECT id, {SHOWN} FROM made"""


def pack_sql(batch: str) -> str:
    return f"""WITH {TOKENIZED}, o AS (SELECT *, md5(id::VARCHAR || ':42') AS o FROM tokens), n AS (SELECT *, {batch} AS batch FROM o),
        p AS (SELECT *, (sum(len(ids)) OVER (PARTITION BY batch ORDER BY o) - len(ids))::BIGINT AS pos FROM n), t AS (SELECT batch, pos, unnest(ids) AS x, unnest(range(0, len(ids))) AS k FROM p)
        SELECT batch, block, n, ids_md5 FROM (SELECT batch, (pos + k) // 1024 AS block, count(*) AS n, md5(string_agg(x::VARCHAR, ',' ORDER BY pos + k)) AS ids_md5 FROM t GROUP BY ALL) WHERE n = 1024"""


def prompts_sql(missing: int | None) -> str:
    gone = "0" if missing is None else f"floor({d('missing', 'k')} * {missing + 1})::BIGINT"
    gone_after = "0" if missing is None else f"{missing} - g"
    tail = "list_concat([50002], mid)" if missing is None else "[50002]"
    return f"""WITH {FILES}, {SPANS}, j AS (SELECT s.*, t.content FROM spans s JOIN texts t ON t.id = s.id),
        i AS (SELECT *, {FULL_KEY} AS k, {TOKENS.format(t='substr(content, 1, location_start)')} AS p0, {TOKENS.format(t='substr(content, location_start + 1, greatest(location_end - location_start, 0))')} AS mid,
            {TOKENS.format(t='substr(content, location_end + 1)')} AS s0 FROM j),
        b AS (SELECT *, 256 - len(mid) - 3 AS budget FROM i), c AS (SELECT *, least(len(p0), budget // 2) AS np FROM b), e AS (SELECT *, least(len(s0), budget - np) AS ns, {gone} AS g FROM c),
        f AS (SELECT *, p0[len(p0) - np + 1:greatest(len(p0) - g, len(p0) - np)] AS pre, s0[least({gone_after}, ns) + 1:ns] AS suf FROM e),
        m AS (SELECT *, CASE WHEN budget > 0 THEN CASE WHEN {d('spm', 'k')} < 0.5 THEN list_concat([50001], suf, [50000], pre, {tail}) ELSE list_concat([50000], pre, [50001], suf, {tail}) END END AS ids FROM f)
        SELECT {SPAN_KEY}, piiType, "value", CASE WHEN budget > 0 THEN len(pre) + len(suf) + {2 if missing is None else 3} END AS middle_start, {SHOWN} FROM m"""


ANSWERS = """answers AS (SELECT *, CASE id % 4 WHEN 0 THEN body WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'I think ' || body || ' fits' ELSE 'no idea ' || reason END AS answer
    FROM (SELECT *, '{"score": ' || score || ', "reason": "' || translate(reason, '"\\', '''''') || '"}' AS body FROM (SELECT DISTINCT id, location_start, coalesce(score, 0) AS score, coalesce(reason, 'none') AS reason FROM judged_records)))"""
RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY piiType ORDER BY md5({FULL_KEY} || ':42')) AS r FROM spans)"
SCORE = "least(greatest(coalesce(score, 0), 0), 255)"
SINGLE = f"single AS (SELECT * FROM spans {{where}} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, md5({FULL_KEY} || ':42')) = 1), best AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY piiType ORDER BY {SCORE} DESC, md5({FULL_KEY} || ':42')) <= {{cap}})"
SQL = {
    "context_windows": f"{BASE} SELECT {SPAN_KEY}, piiType, length(context) AS n, md5(context) AS context_md5 FROM contexts",
    "prompt_cache_keys": f"{BASE} SELECT {SPAN_KEY}, piiType, {CACHE_KEY} AS cache_key FROM contexts",
    "cache_lookup": f"""{BASE}, asked AS (SELECT *, {CACHE_KEY} AS cache_key FROM contexts), stored AS (SELECT DISTINCT cache_key FROM asked WHERE id % 2 = 0)
        SELECT piiType, count(*) AS n, count(CASE WHEN piiType <> 'password' THEN s.cache_key END) AS n_hits FROM asked a LEFT JOIN stored s ON s.cache_key = a.cache_key GROUP BY ALL""",
    "parse_judge_json": f"""WITH {ANSWERS} SELECT DISTINCT id, location_start, CASE id % 4 WHEN 3 THEN 0 ELSE coalesce(regexp_extract(answer, '"score": ([0-9]+)', 1)::INTEGER, 0) END AS parsed_score,
        CASE id % 4 WHEN 3 THEN answer ELSE regexp_extract(answer, '"reason": "([^"]*)"', 1) END AS parsed_reason FROM answers""",
    "refine_fold": f"{BASE}, {JUDGED}, {fold_sql()} SELECT * FROM folded",
    "judge_counters": f"""{BASE}, {JUDGED}, {fold_sql()}, seen AS (SELECT piiType, count(*) AS n_all, count(*) FILTER (NOT ({IN_PLACE})) AS n_missing FROM records GROUP BY ALL),
        done AS (SELECT piiType, count(*) AS n_judged, sum(above)::BIGINT AS n_above FROM folded GROUP BY ALL)
        SELECT s.piiType, n_all, n_missing, coalesce(n_judged, 0) AS n_judged, coalesce(n_above, 0) AS n_above FROM seen s LEFT JOIN done d ON d.piiType = s.piiType""",
    "stratified_split": f"""WITH {SPANS}, {RANKED} SELECT * EXCLUDE (r), CASE WHEN r <= 40 THEN 'train' WHEN r <= 50 THEN 'val' ELSE 'test' END AS split FROM ranked""",
    "one_per_file": f"WITH {SPANS}, {SINGLE.format(where='', cap=1530)} SELECT * FROM best",
    "ratio_split": f"""WITH {SPANS}, {SINGLE.format(where='WHERE score >= 80', cap=1000)}, r AS (SELECT *, row_number() OVER (PARTITION BY piiType ORDER BY md5({FULL_KEY} || ':ratio:42')) / count(*) OVER (PARTITION BY piiType) AS share FROM best)
        SELECT * EXCLUDE (share), CASE WHEN share <= 0.8 THEN 'train' WHEN share <= 0.9 THEN 'val' ELSE 'test' END AS split FROM r""",
    "enrich_samples": f"""WITH {SPANS}, t AS (SELECT DISTINCT fileId, content FROM code_files) SELECT s.id, location_start, location_end, piiType, "value", length(content) AS n, md5(content) AS text_md5 FROM spans s JOIN t ON t.fileId = s.id""",
    "duplicate_spans": f"SELECT {SPAN_KEY}, count(*) AS n FROM judged_records GROUP BY ALL HAVING count(*) > 1",
    "tokenize_files": f"WITH {TOKENIZED} SELECT id, {SHOWN} FROM tokens",
    "fim_transform": fim_sql(0.5, 0.5, "list_concat([50001], suf, [50000], pre, [50002], mid)"),
    "fim_older_order": fim_sql(1.0, 1.0, "list_concat([50000], [50001], suf, [50002], pre, mid)"),
    "pack_blocks_batch": pack_sql("(row_number() OVER (ORDER BY o) - 1) // 1000"),
    "pack_blocks": pack_sql("0"),
    "span_parts": f"""WITH {FILES}, {SPANS} SELECT s.id, location_start, location_end, piiType, "value", length(substr(content, 1, location_start)) AS n_prefix,
        md5(substr(content, location_start + 1, greatest(location_end - location_start, 0))) AS middle_md5, length(substr(content, location_end + 1)) AS n_suffix FROM spans s JOIN texts t ON t.id = s.id""",
    "dynamic_prompts": prompts_sql(None),
    "attack_prompts": prompts_sql(50),
    "pad_batches": f"""WITH {TOKENIZED}, n AS (SELECT id, len(ids) AS own, (row_number() OVER (ORDER BY md5(id::VARCHAR || ':42')) - 1) // 32 AS batch FROM tokens)
        SELECT id, batch, max(own) OVER (PARTITION BY batch) AS n, own AS n_masked, max(own) OVER (PARTITION BY batch) - own AS n_ignored FROM n""",
    "simulated_predictions": f"""WITH {SPANS}, i AS (SELECT *, {FULL_KEY} AS k, coalesce({TOKENS.format(t='"value"')}, []) AS ids FROM spans),
        p AS (SELECT *, list_transform(range(0, len(ids)), lambda x: ('0x' || substr(md5(k || ':' || x || ':42'), 1, 8))::BIGINT / 4294967296.0) AS probs FROM i)
        SELECT id, location_start, location_end, piiType, "value", len(ids) AS n, len(list_filter(probs, lambda x: x >= 1 - 0.6)) AS n_right, round(coalesce(list_sum(probs), 0.0), 5) AS sum_probs FROM p""",
}
