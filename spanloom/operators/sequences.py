"""Token sequences: tokens, fill-in-the-middle, packing, prompts, batches.

Sequences are array<int> columns. The default tokenizer takes runs of word characters and single marks, and numbers them by
hash; another one is any function from a text column to an array. Random draws depend on the key of a row and a seed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.ranking import running_before
from spanloom.functions.text import draw, let, rank_key

VOCABULARY = 50_000
PREFIX, SUFFIX, MIDDLE = 50_000, 50_001, 50_002
PAD_LABEL = -100
BLOCK = 1024


def hash_tokens(text: Column) -> Column:
    """T1, the default tokenizer."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), F.lit(0))
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % VOCABULARY).cast("int"))


def tokenize(rows: DataFrame, key: list[str], text: str, tokenizer: Callable[[Column], Column] = hash_tokens) -> DataFrame:
    return rows.select(*key, tokenizer(F.col(text)).alias("input_ids"))


def _part(ids: Column, a: Column, b: Column) -> Column:
    """ids[a:b], counted from 0."""
    return F.slice(ids, a + 1, F.greatest(b - a, F.lit(0)))


def fim(ids: Column, *key: Column, rate: float = 0.5, spm_rate: float = 0.5, seed: int = 42, keep_length: bool = True, spm_style: str = "suffix-first") -> Column:
    """With probability `rate` the sequence is cut at two places and rearranged, suffix first with probability
    `spm_rate`; the three marks take the place of up to three tokens at the end of the suffix. spm_style "prefix-mark-first"
    is the older order (T2b)."""
    one = F.array
    p, s, m = (one(F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    u, v = (F.floor(draw(*key, F.lit(name), seed=seed) * (F.size(ids) + 1)).cast("int") for name in ("cut1", "cut2"))

    def arranged(cut: Column) -> Column:
        end = F.size(ids)
        keep = F.greatest(end - 3, cut["b"]) if keep_length else end
        before, middle, after = _part(ids, F.lit(0), cut["a"]), _part(ids, cut["a"], cut["b"]), _part(ids, cut["b"], keep)
        spm = F.concat(s, after, p, before, m, middle) if spm_style == "suffix-first" else F.concat(p, s, after, m, before, middle)
        return F.when(draw(*key, F.lit("spm"), seed=seed) < spm_rate, spm).otherwise(F.concat(p, before, s, after, m, middle))

    cuts = F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    return F.when(draw(*key, F.lit("fim"), seed=seed) < rate, let(cuts, arranged)).otherwise(ids)


def plain_labels(rows: DataFrame) -> DataFrame:
    """Labels as the input, a mask of ones."""
    return rows.withColumns({"labels": F.col("input_ids"), "attention_mask": F.transform("input_ids", lambda _: F.lit(1))})


def pack(rows: DataFrame, key: list[str], block: int = BLOCK, batch_rows: int | None = 1000) -> DataFrame:
    """T4, T5: (batch, block, input_ids): sequences one after the other, cut into blocks; a remainder is dropped, in each batch
    of batch_rows rows or, without it, once at the end. Rows follow each other by the hash of their key. Offsets come from
    partial sums, and a block gathers only the pieces that fall into it."""
    ordered = rows.withColumn("order", rank_key(*[F.col(k) for k in key]))
    if batch_rows:
        ordered = running_before(ordered.withColumn("all", F.lit(0)), ["all"], "order", F.lit(1), "nth").withColumn("batch", F.floor(F.col("nth") / batch_rows).cast("long"))
    else:
        ordered = ordered.withColumn("batch", F.lit(0).cast("long"))
    placed = running_before(ordered, ["batch"], "order", F.size("input_ids").cast("long"), "at").filter("size(input_ids) > 0")
    last = F.col("at") + F.size("input_ids") - 1
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor(last / block))))
    low = F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).cast("int")
    high = F.least((F.col("block") + 1) * block - F.col("at"), F.size("input_ids").cast("long")).cast("int")
    pieces = pieces.select("batch", "block", F.struct((F.col("at") + low).alias("at"), _part(F.col("input_ids"), low, high).alias("ids")).alias("piece"))
    blocks = pieces.groupBy("batch", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["ids"])).alias("input_ids"))
    return blocks.filter(F.size("input_ids") == block)


def block_size(configured: int | None, tokenizer_most: int, positions: int) -> int:
    """What the tokenizer allows, at most as configured; without a setting at most 1024 and the model's positions."""
    if configured is None:
        return min(1024, positions) if tokenizer_most > positions else tokenizer_most
    return min(configured, tokenizer_most)


def split_at_span(rows: DataFrame, text: str = "text") -> DataFrame:
    """The text before, in and after each span."""
    a, b = F.col("location_start"), F.col("location_end")
    return rows.withColumns({
        "prefix": F.substring(text, F.lit(1), a),
        "middle": F.substring(text, a + 1, F.greatest(b - a, F.lit(0))),
        "suffix": F.substring(text, b + 1, F.greatest(F.length(text) - b, F.lit(0))),
    })


def prompts(rows: DataFrame, key: list[str], block: int = BLOCK, missing: int | None = None, spm_rate: float = 0.5, seed: int = 42) -> DataFrame:
    """T7 (missing=None): prefix, suffix and middle within a block, with the position before the first middle token.
    T8: without the middle, after `missing` tokens next to it are taken away on both sides together; the position is the
    one after the mark. Rows whose middle leaves no room are marked by a null input_ids."""
    k = [F.col(c) for c in key]
    pre, mid, suf = F.col("prefix_ids"), F.col("middle_ids"), F.col("suffix_ids")
    budget = F.lit(block) - F.size(mid) - 3
    half = F.floor(budget / 2).cast("int")
    n_pre = F.least(F.size(pre), half)
    n_suf = F.least(F.size(suf), budget - n_pre)
    gone = F.lit(0) if missing is None else F.floor(draw(*k, F.lit("missing"), seed=seed) * (missing + 1)).cast("int")
    gone_after = F.lit(0) if missing is None else F.lit(missing) - gone
    kept_pre = _part(pre, F.size(pre) - n_pre, F.greatest(F.size(pre) - gone, F.size(pre) - n_pre))
    kept_suf = _part(suf, F.least(gone_after, n_suf), n_suf)
    p, s, m = (F.array(F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    tail = F.concat(m, mid) if missing is None else m

    def built(x: Column) -> Column:
        ids = F.when(draw(*k, F.lit("spm"), seed=seed) < spm_rate, F.concat(s, x["suf"], p, x["pre"], tail)).otherwise(F.concat(p, x["pre"], s, x["suf"], tail))
        return F.struct(ids.alias("ids"), (F.size(x["pre"]) + F.size(x["suf"]) + (2 if missing is None else 3)).alias("at"))

    made = F.when(budget > 0, let(F.struct(kept_pre.alias("pre"), kept_suf.alias("suf")), built))
    out = rows.withColumn("made", made)
    return out.select(*key, F.col("made.ids").alias("input_ids"), F.col("made.at").alias("middle_start"), F.col("middle_ids"))


def batches(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """Consecutive groups of a fixed size by the hash of the key, the last one smaller."""
    ordered = rows.withColumns({"order": rank_key(*[F.col(c) for c in key]), "all": F.lit(0)})
    return running_before(ordered, ["all"], "order", F.lit(1), "nth").withColumn("batch", F.floor(F.col("nth") / size).cast("long")).drop("order", "all", "nth")


def pad(rows: DataFrame, pad_id: int = 0) -> DataFrame:
    """Every sequence as long as the longest of its batch, with mask and labels."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    out = rows.withColumn("lack", longest - F.size("input_ids"))
    fill = lambda x: F.array_repeat(F.lit(x), F.col("lack"))
    return out.withColumns({
        "labels": F.concat("input_ids", fill(PAD_LABEL)),
        "attention_mask": F.concat(F.transform("input_ids", lambda _: F.lit(1)), fill(0)),
        "input_ids": F.concat("input_ids", fill(pad_id)),
    }).drop("lack")


def checkpoints(epochs: int, base: str = "base_model", tuned: str | None = None) -> list[tuple[str, str | None]]:
    """(label, revision) of the base and each epoch."""
    return [(base, None), *((f"epoch-{i}", f"{tuned}-epoch-{i}" if tuned else None) for i in range(1, epochs + 1))]
