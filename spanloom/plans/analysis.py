"""Queries of metrics, training dynamics, attacks, covariates, effects and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import attack, causal, covariates, dynamics, metrics, reports
from spanloom.operators.sequences import hash_tokens
from spanloom.plans.sql import lit
from spanloom.plans.training import TOKENS
from spanloom.sources.files import last_number
from spanloom.sources.parquet import table


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "dynamic_predictions").distinct()


def _spans(spark, sf_dir):
    spans = dynamics.confidence_variability(table(spark, sf_dir, "dynamic_predictions"))
    return dynamics.with_hits(spans, dynamics.own_hits(table(spark, sf_dir, "attack_predictions")))


def confidence_variability(spark, sf_dir):
    """The flagship: confidence and variability of each span over the checkpoints, with its attack flag."""
    return _spans(spark, sf_dir)


def token_accuracy_by_ckpt(spark, sf_dir):
    predicted = F.concat(hash_tokens(F.col("predicted_words")), F.array(F.lit(0)))
    labels = F.concat(F.array(F.lit(metrics.IGNORED)), hash_tokens(F.col("expected_words")))
    rows = _predictions(spark, sf_dir).withColumn("hits", metrics.shifted_hits(predicted, labels))
    return metrics.accuracy_by(rows.select("checkpoint", "type", "hits.correct", "hits.total"), "checkpoint", "type")


def span_accuracy(spark, sf_dir):
    hits = metrics.span_hits(hash_tokens(F.col("predicted_words")), hash_tokens(F.col("expected_words")), F.lit(0))
    rows = _predictions(spark, sf_dir).withColumn("hits", hits).select("checkpoint", "type", "hits.correct", "hits.total")
    return metrics.accuracy_by(rows, "checkpoint", "type")


def checkpoint_perplexity(spark, sf_dir):
    """Mean probability of the true tokens and perplexity per checkpoint."""
    p = _predictions(spark, sf_dir).select("checkpoint", F.explode("pred_token_probs").alias("p")).filter("p > 0")
    out = p.groupBy("checkpoint").agg(F.count("*").alias("n"), F.round(F.avg("p"), 5).alias("mean_probability"), F.avg(-F.log("p")).alias("loss"))
    return out.select("checkpoint", "n", "mean_probability", F.round(metrics.perplexity(F.col("loss")), 6).alias("perplexity"))


def summary_parsed(spark, sf_dir):
    return metrics.parse_summary(table(spark, sf_dir, "eval_summary"))


def top3_predictions(spark, sf_dir):
    rows = _predictions(spark, sf_dir).select("type", "checkpoint", "example_id", "expected_words", F.coalesce("predicted_words", F.lit("")).alias("predicted"), F.coalesce("evaluated_at", F.lit("1970-01-01").cast("timestamp")).cast("string").alias("at"))
    return metrics.first_of_type(rows, "type", 3, "example_id", "checkpoint", "expected_words", "predicted", "at").drop("at")


def cut_answers(spark, sf_dir):
    return table(spark, sf_dir, "attack_predictions").distinct().select("example_id", "type", "middle_start", F.md5(metrics.cut_answer(F.concat("generated_text", F.lit("</s> rest <fim_end>")))).alias("answer_md5"))


def attack_summary(spark, sf_dir):
    return metrics.attack_summary(table(spark, sf_dir, "attack_predictions"))


def without_predictions(spark, sf_dir):
    return dynamics.without_predictions(table(spark, sf_dir, "judged_records"), table(spark, sf_dir, "dynamic_predictions"))


def dynamics_by_type(spark, sf_dir):
    return dynamics.by_type(_spans(spark, sf_dir))


def dynamics_histogram(spark, sf_dir):
    return dynamics.histogram(_spans(spark, sf_dir), "confidence")


def variability_histogram(spark, sf_dir):
    return dynamics.histogram(_spans(spark, sf_dir), "variability")


def grid_downsample(spark, sf_dir):
    return dynamics.downsample(_spans(spark, sf_dir), dynamics.SPAN, 0.5, 10).select(*dynamics.SPAN, "confidence", "variability")


def loss_curve(spark, sf_dir):
    """Trainer states made from events: one log per user, some entries without a loss."""
    entry = F.struct(F.dayofmonth("ts").cast("double").alias("epoch"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("loss"), F.col("event_id").alias("step"))
    states = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(entry).alias("log_history"))  # the events of one user, a bounded log
    text = F.to_json(F.struct("log_history"))
    return dynamics.loss_curve(states.select("user_id", text.alias("state")), ["user_id"], "state").withColumn("loss", F.round("loss", 6))


def attack_hits_any(spark, sf_dir):
    return attack.any_answer_hits(table(spark, sf_dir, "attack_predictions"))


def attack_hits_own(spark, sf_dir):
    return attack.own_answer_hits(table(spark, sf_dir, "attack_predictions"))


def attack_hit_rate(spark, sf_dir):
    return attack.hit_rates(_spans(spark, sf_dir))


def _code(spark, sf_dir):
    return table(spark, sf_dir, "code_files").select("fileId", "path", "content").distinct().filter("content is not null")


def whitespace_tokens(spark, sf_dir):
    return _code(spark, sf_dir).select("fileId", covariates.word_count(F.col("content")).alias("n_tokens"))


def classify_quantile(spark, sf_dir):
    return covariates.classify(_spans(spark, sf_dir)).select(*dynamics.SPAN, "class")


def class_counts(spark, sf_dir):
    return covariates.value_counts(covariates.classify(_spans(spark, sf_dir)), "class")


def code_format(spark, sf_dir):
    return _code(spark, sf_dir).select("fileId", covariates.format_code(F.col("content")).alias("formatted"))


def function_metrics(spark, sf_dir):
    return _code(spark, sf_dir).select("fileId", *[c.alias(n) for n, c in covariates.function_metrics(F.col("content")).items()])


def tree_metrics(spark, sf_dir):
    return _code(spark, sf_dir).select("fileId", *[c.alias(n) for n, c in covariates.tree_metrics(F.col("content")).items() if n != "t_ast_levels"])


def bracket_depth(spark, sf_dir):
    return _code(spark, sf_dir).select("fileId", covariates.depth(F.col("content")).alias("t_ast_levels"))


def minmax_relative(spark, sf_dir):
    spans = _spans(spark, sf_dir).filter("confidence is not null")
    members, others = spans.filter("attack_hit"), spans.filter("not attack_hit")
    return covariates.relative_score(members, others, "confidence").select(*dynamics.SPAN, F.round("relative_confidence", 6).alias("relative_confidence"))


def rule_labels(spark, sf_dir):
    """Labels in paths; the files have none, so one is put before each name that has an underscore."""
    path = F.regexp_replace("path", r"([a-z]+_\w+)\.", "rule_$1.")
    return covariates.value_counts(table(spark, sf_dir, "code_files").select("fileId", path.alias("path")).distinct().withColumn("label", F.coalesce(covariates.rule_label(F.col("path")), F.lit("none"))), "label")


def _grouped(spark, sf_dir):
    rows = covariates.with_group(covariates.classify(_spans(spark, sf_dir)))
    return covariates.outcome(rows.filter("group is not null"), "model")


def _contrasts(spark, sf_dir):
    rows = _grouped(spark, sf_dir)
    both = [rows.filter(F.col("group").isin("T0", t)).withColumns({"treatment": F.lit(t), "treated": (F.col("group") == t).cast("int")}) for t in ("T1", "T2")]
    return both[0].union(both[1])


def contrasts(spark, sf_dir):
    return _contrasts(spark, sf_dir).groupBy("treatment", "type").agg(F.count("*").alias("n"), F.sum("treated").alias("n_treated"), F.sum("outcome").alias("n_hits"))


def correlations(spark, sf_dir):
    return causal.correlations(_contrasts(spark, sf_dir), ["treatment", "type"])


def naive_effect(spark, sf_dir):
    return causal.naive_effect(_contrasts(spark, sf_dir), ["treatment", "type"])


def effect_unpivot(spark, sf_dir):
    rows = causal.correlations(_contrasts(spark, sf_dir), ["treatment", "type"]).join(causal.naive_effect(_contrasts(spark, sf_dir), ["treatment", "type"]), ["treatment", "type"])
    return causal.long_form(rows, ["treatment", "type"], ["pearson_corr", "effect"])


def dynamics_describe(spark, sf_dir):
    return causal.describe(_spans(spark, sf_dir), "type", "confidence")


def _causal_rows(spark, sf_dir):
    code = table(spark, sf_dir, "code_files").select(F.col("fileId").alias("example_id"), "content").dropDuplicates(["example_id"])
    names = {**covariates.function_metrics(F.col("content")), **covariates.tree_metrics(F.col("content"))}
    values = code.select("example_id", *[F.coalesce(c, F.lit(0)).cast("double").alias(n) for n, c in names.items() if n in causal.COVARIATES])
    key = F.concat_ws(":", "example_id", "type", "expected_words", "treatment")
    return _contrasts(spark, sf_dir).join(values, "example_id").withColumn("key", key).select("key", "treatment", "type", "treated", "outcome", *causal.COVARIATES)


def psm_effect(spark, sf_dir):
    """Matched, stratified and weighted effects and their refuters for each treatment over all types."""
    from spanloom.sources.durable import written

    rows = written(_causal_rows(spark, sf_dir), "causal")
    out = [(t, name, value) for t in ("T1", "T2") for name, value in causal.effects(rows.filter(F.col("treatment") == t), "key")]
    return spark.createDataFrame(out, "treatment string, method string, effect double")


def _marked(spark, sf_dir):
    record = "transform(piiRecords, r -> named_struct('piiType', r.piiType, 'location_start', r.location_start, 'location_end', r.location_end, 'value', r.value))"
    files = table(spark, sf_dir, "code_files").filter("content is not null").dropDuplicates(["fileId"])
    return files.select("fileId", "path", "content", F.expr(f"coalesce({record}, array())").alias("records"))


def highlight_html(spark, sf_dir):
    return _marked(spark, sf_dir).select("fileId", reports.report_page("spans", reports.html(F.col("content"), F.col("records"))).alias("page"))


def highlight_terminal(spark, sf_dir):
    return _marked(spark, sf_dir).select("fileId", reports.terminal(F.col("content"), F.col("records"), 1000).alias("shown"))


def record_lines(spark, sf_dir):
    return reports.record_lines(table(spark, sf_dir, "judged_records").distinct()).select("id", "location_start", "line").distinct()


def normalised_shapes(spark, sf_dir):
    return reports.normalise_shapes(_marked(spark, sf_dir)).select("id", "path", F.length("text").alias("n"), F.size("records").alias("n_records"))


def latest_ratings(spark, sf_dir):
    """Ratings made from events: the value modulo five, of which only 1 to 3 are ratings."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("file"), (F.col("event_id") % 5).cast("int").alias("rating"), F.col("event_id").alias("rated_at"))
    return reports.latest_ratings(rows)


def type_colours(spark, sf_dir):
    return table(spark, sf_dir, "judged_records").select("piiType").distinct().withColumn("colour", reports.colour(F.col("piiType")))


def natural_file_sort(spark, sf_dir):
    return table(spark, sf_dir, "code_files").select("fileId", "path").distinct().filter("path is not null").withColumn("number", last_number(F.col("path")))


QUERIES = {f.__name__: f for f in (
    confidence_variability, token_accuracy_by_ckpt, span_accuracy, checkpoint_perplexity, summary_parsed, top3_predictions, cut_answers, attack_summary, without_predictions,
    dynamics_by_type, dynamics_histogram, variability_histogram, grid_downsample, loss_curve, attack_hits_any, attack_hits_own, attack_hit_rate, whitespace_tokens,
    classify_quantile, class_counts, code_format, function_metrics, tree_metrics, bracket_depth, minmax_relative, rule_labels, contrasts, correlations, naive_effect,
    effect_unpivot, dynamics_describe, psm_effect, highlight_html, highlight_terminal, record_lines, normalised_shapes, latest_ratings, type_colours, natural_file_sort,
)}

DYNAMICS = """preds AS (SELECT DISTINCT * FROM dynamic_predictions), means AS (SELECT example_id, type, expected_words, list_avg(pred_token_probs) AS mean FROM preds),
    cv AS (SELECT example_id, type, expected_words, count(mean) AS n_predictions, round(avg(mean), 9) AS confidence, round(stddev_pop(mean), 9) AS variability FROM means GROUP BY ALL),
    hits AS (SELECT example_id, type, expected_text, bool_or(coalesce(contains(generated_text, expected_text), false)) AS hit FROM attack_predictions GROUP BY ALL),
    dyn AS (SELECT s.*, coalesce(h.hit, false) AS attack_hit FROM cv s LEFT JOIN hits h ON s.example_id IS NOT DISTINCT FROM h.example_id
        AND s.type IS NOT DISTINCT FROM h.type AND s.expected_words IS NOT DISTINCT FROM h.expected_text)"""
SPAN_COLS = "example_id, type, expected_words"
ACC = f"""WITH preds AS (SELECT DISTINCT * FROM dynamic_predictions), t AS (SELECT checkpoint, type, {TOKENS.format(t="coalesce(predicted_words, '')")} AS p, {TOKENS.format(t="coalesce(expected_words, '')")} AS e FROM preds),
    n AS (SELECT checkpoint, type, least(len(p), len(e)) AS total, len(list_filter(range(1, least(len(p), len(e)) + 1), lambda i: p[i] = e[i])) AS correct FROM t)
    SELECT checkpoint, type, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, round(CASE WHEN sum(total) > 0 THEN sum(correct) / sum(total) ELSE 0.0 END, 6) AS accuracy FROM n GROUP BY GROUPING SETS ((checkpoint, type), (checkpoint))"""
BINS = " ".join(f"WHEN x >= {a!r}::DOUBLE AND x {'<' if i < 9 else '<='} {b!r}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(dynamics.EDGES, dynamics.EDGES[1:])))


def hist_sql(column: str) -> str:
    return f"""WITH {DYNAMICS}, b AS (SELECT type, CASE {BINS} END AS bin FROM (SELECT type, {column} AS x FROM dyn))
        SELECT type, bin, count(*) AS n, round(count(*) / 1200.0, 2) AS rate FROM b WHERE bin IS NOT NULL GROUP BY ALL"""


CLASSES = f"""{DYNAMICS}, q AS (SELECT quantile_cont(confidence, 0.25) AS cl, quantile_cont(confidence, 0.75) AS ch, quantile_cont(variability, 0.25) AS vl, quantile_cont(variability, 0.75) AS vh FROM dyn),
    classes AS (SELECT dyn.*, CASE WHEN confidence IS NULL OR variability IS NULL THEN NULL WHEN variability >= vh THEN 'ambiguous' WHEN variability <= vl AND confidence >= ch THEN 'easy'
        WHEN variability <= vl AND confidence <= cl THEN 'hard' WHEN variability > (vh + vl) / 2 THEN 'ambiguous' WHEN confidence >= (ch + cl) / 2 THEN 'easy' ELSE 'hard' END AS class FROM dyn, q)"""
CONTRASTS = f"""{CLASSES}, grouped AS (SELECT *, CASE class WHEN 'easy' THEN 'T0' WHEN 'hard' THEN 'T1' WHEN 'ambiguous' THEN 'T2' END AS g, attack_hit::INTEGER AS outcome FROM classes WHERE class IS NOT NULL),
    contrasts AS (SELECT t AS treatment, type, (g = t)::INTEGER AS treated, outcome FROM grouped, (VALUES ('T1'), ('T2')) AS v(t) WHERE g IN ('T0', t))"""
PHI = """CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 6) END"""
CORR = f"""{CONTRASTS}, n AS (SELECT treatment, type, count(*) FILTER (treated = 1 AND outcome = 1)::DOUBLE AS a, count(*) FILTER (treated = 1 AND outcome = 0)::DOUBLE AS b,
    count(*) FILTER (treated = 0 AND outcome = 1)::DOUBLE AS c, count(*) FILTER (treated = 0 AND outcome = 0)::DOUBLE AS d FROM contrasts GROUP BY ALL)"""
NAIVE = "SELECT treatment, type, count(*) AS n, round(avg(outcome) FILTER (treated = 1) - avg(outcome) FILTER (treated = 0), 6) AS effect FROM contrasts GROUP BY ALL"
NODES = "len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"
PAIR = lambda a, b: f"abs((length(content) - length(replace(content, '{a}', ''))) - (length(content) - length(replace(content, '{b}', ''))))"
BLANK_WORDS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CODE = "code AS (SELECT DISTINCT fileId, path, content FROM code_files WHERE content IS NOT NULL)"
GRID = f"""{DYNAMICS}, k AS (SELECT * FROM dyn WHERE confidence IS NOT NULL AND variability IS NOT NULL),
    e AS (SELECT min(variability) AS lv, max(variability) AS hv, min(confidence) AS lc, max(confidence) AS hc FROM k),
    c AS (SELECT k.*, CASE WHEN hv > lv THEN least(floor((variability - lv) / (hv - lv) * 10), 9) ELSE 0 END AS x, CASE WHEN hc > lc THEN least(floor((confidence - lc) / (hc - lc) * 10), 9) ELSE 0 END AS y FROM k, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY md5(concat_ws(':', coalesce(example_id::VARCHAR, ''), coalesce(type, ''), coalesce(expected_words, ''), '42'))) AS nth, count(*) OVER (PARTITION BY x, y) AS size FROM c)"""
SUMMARY = lit(metrics.SUMMARY.replace(r"\S", "[^ ]").replace(r"\d", "[0-9]").replace(r"\s", " "))
SQL = {
    "confidence_variability": f"WITH {DYNAMICS} SELECT * FROM dyn",
    "token_accuracy_by_ckpt": ACC,
    "span_accuracy": ACC,
    "checkpoint_perplexity": """WITH p AS (SELECT checkpoint, unnest(pred_token_probs) AS p FROM (SELECT DISTINCT * FROM dynamic_predictions))
        SELECT checkpoint, count(*) AS n, round(avg(p), 5) AS mean_probability, round(exp(avg(-ln(p))), 6) AS perplexity FROM p WHERE p > 0 GROUP BY ALL""",
    "summary_parsed": f"""SELECT experiment, line_no, regexp_extract(line, {SUMMARY}, 1) AS checkpoint, lower(regexp_extract(line, {SUMMARY}, 2)) AS split, regexp_extract(line, {SUMMARY}, 3)::DOUBLE AS accuracy,
        regexp_extract(line, {SUMMARY}, 4)::BIGINT AS correct, regexp_extract(line, {SUMMARY}, 5)::BIGINT AS total FROM eval_summary WHERE regexp_matches(line, {SUMMARY})""",
    "top3_predictions": """SELECT type, checkpoint, example_id, expected_words, coalesce(predicted_words, '') AS predicted, row_number() OVER (PARTITION BY type ORDER BY example_id, checkpoint, expected_words,
        coalesce(predicted_words, ''), strftime(coalesce(evaluated_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S')) AS nth FROM (SELECT DISTINCT * FROM dynamic_predictions) QUALIFY nth <= 3""",
    "cut_answers": """SELECT example_id, type, middle_start, md5(split_part(generated_text || '</s> rest <fim_end>', '<fim_end>', 1)) AS answer_md5 FROM (SELECT DISTINCT * FROM attack_predictions)""",
    "attack_summary": "SELECT count(generated_text) AS generated_count, count(*) AS total, round(CASE WHEN count(*) > 0 THEN count(generated_text) / count(*) ELSE 0.0 END, 6) AS rate FROM (SELECT DISTINCT * FROM attack_predictions)",
    "without_predictions": "SELECT DISTINCT id FROM judged_records WHERE id NOT IN (SELECT example_id FROM dynamic_predictions WHERE example_id IS NOT NULL)",
    "dynamics_by_type": f"WITH {DYNAMICS} SELECT type, count(confidence) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(variability), 6) AS mean_variability FROM dyn GROUP BY ALL",
    "dynamics_histogram": hist_sql("confidence"),
    "variability_histogram": hist_sql("variability"),
    "grid_downsample": f"WITH {GRID} SELECT {SPAN_COLS}, confidence, variability FROM r WHERE nth <= greatest(floor(size * 0.5), 1)",
    "loss_curve": "SELECT user_id, day(ts)::DOUBLE AS epoch, event_id AS step, round(value, 6) AS loss FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL",
    "attack_hits_any": """WITH a AS (SELECT DISTINCT example_id, type, expected_text, generated_text FROM attack_predictions)
        SELECT a.example_id, a.type, a.expected_text, count(DISTINCT b.expected_text) AS n_values FROM a JOIN a b ON a.type = b.type AND b.expected_text <> '' AND contains(a.generated_text, b.expected_text) GROUP BY ALL""",
    "attack_hits_own": "SELECT type, count(DISTINCT expected_text) AS n_values, count(DISTINCT example_id) AS n_files FROM attack_predictions WHERE contains(generated_text, expected_text) AND expected_text <> '' GROUP BY ALL",
    "attack_hit_rate": f"WITH {DYNAMICS} SELECT type, count(*) AS n, sum(attack_hit::INTEGER)::BIGINT AS n_hits, round(100.0 * sum(attack_hit::INTEGER) / count(*), 2) AS rate FROM dyn GROUP BY ALL",
    "whitespace_tokens": f"WITH {CODE} SELECT fileId, len(list_filter(regexp_split_to_array(content, {lit(BLANK_WORDS)}), lambda w: w <> '')) AS n_tokens FROM code",
    "classify_quantile": f"WITH {CLASSES} SELECT {SPAN_COLS}, class FROM classes",
    "class_counts": f"WITH {CLASSES} SELECT class, count(*) AS n FROM classes GROUP BY ALL",
    "tree_metrics": f"""WITH {CODE} SELECT fileId, {NODES} AS t_n_ast_nodes, {PAIR('(', ')')} + {PAIR('[', ']')} + {PAIR('{', '}')} AS t_n_ast_errors,
        len(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) AS t_n_identifiers FROM code""",
    "minmax_relative": f"WITH {DYNAMICS}, e AS (SELECT min(confidence) AS l, max(confidence) AS h FROM dyn) SELECT {SPAN_COLS}, round((confidence - l) / (h - l + 1e-15), 6) AS relative_confidence FROM dyn, e WHERE attack_hit AND confidence IS NOT NULL",
    "rule_labels": r"""WITH p AS (SELECT DISTINCT fileId, regexp_replace(path, '([a-z]+_[A-Za-z0-9_]+)\.', 'rule_\1.', 'g') AS path FROM code_files)
        SELECT CASE WHEN coalesce(regexp_extract(path, '(rule_[A-Za-z0-9_]+)', 1), '') = '' THEN 'none' ELSE regexp_extract(path, '(rule_[A-Za-z0-9_]+)', 1) END AS label, count(*) AS n FROM p GROUP BY ALL""",
    "contrasts": f"WITH {CONTRASTS} SELECT treatment, type, count(*) AS n, sum(treated)::BIGINT AS n_treated, sum(outcome)::BIGINT AS n_hits FROM contrasts GROUP BY ALL",
    "correlations": f"WITH {CORR} SELECT treatment, type, {PHI} AS pearson_corr, {PHI} AS spearman_corr, {PHI} AS kendall_corr FROM n",
    "naive_effect": f"WITH {CONTRASTS} {NAIVE}",
    "effect_unpivot": f"""WITH {CORR}, v AS ({NAIVE}), r AS (SELECT n.treatment, n.type, {PHI} AS pearson_corr, effect FROM n JOIN v ON v.treatment = n.treatment AND v.type = n.type)
        SELECT treatment, type, 'pearson_corr' AS measure, pearson_corr AS "value" FROM r UNION ALL SELECT treatment, type, 'effect', effect FROM r""",
    "dynamics_describe": f"WITH {DYNAMICS} SELECT type, count(confidence) AS n, round(avg(confidence), 4) AS mean, round(stddev_samp(confidence), 4) AS std, round(min(confidence), 4) AS min, round(max(confidence), 4) AS max FROM dyn GROUP BY ALL",
    "record_lines": """SELECT DISTINCT id, location_start, '[' || coalesce(piiType, '?') || '] ' || coalesce("value", '') || ' (' || location_start || '-' || location_end || ')'
        || CASE WHEN score IS NOT NULL THEN printf(' score %.2f', score::DOUBLE) ELSE '' END || CASE WHEN coalesce(reason, '') <> '' THEN ' because: ' || reason ELSE '' END AS line FROM judged_records""",
    "normalised_shapes": "SELECT DISTINCT fileId AS id, coalesce(path, '') AS path, length(content) AS n, coalesce(len(piiRecords), 0) AS n_records FROM code_files WHERE content IS NOT NULL",
    "latest_ratings": "SELECT user_id AS sample, event_type AS file, arg_max((event_id % 5)::INTEGER, event_id) AS rating FROM events WHERE event_id % 5 BETWEEN 1 AND 3 GROUP BY ALL",
    "type_colours": f"SELECT DISTINCT piiType, CASE piiType {' '.join(f'WHEN {lit(k)} THEN {v}' for k, v in reports.COLOURS.items())} ELSE {reports.OTHER_COLOUR} END AS colour FROM judged_records",
    "natural_file_sort": "SELECT DISTINCT fileId, path, coalesce(try_cast(list_last(regexp_extract_all(path, '[0-9]+')) AS BIGINT), 0) AS number FROM code_files WHERE path IS NOT NULL",
}
