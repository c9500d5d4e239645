"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from spanloom.llm.common import table


def p1_found(spark, sf_dir):
    """Files with a passage that was read with the wrong encoding."""
    from spanloom.llm.encoding import mend_files

    return mend_files(table(spark, sf_dir, "code_files")).select("fileId")


def p1_restored(spark, sf_dir):
    """The original content of the files of which nothing was lost, with the encodings that were mixed up."""
    from spanloom.llm.encoding import mend_files

    return mend_files(table(spark, sf_dir, "code_files")).filter("restorable").select("fileId", "pairs", "content")


def p2_found(spark, sf_dir):
    """Pairs of files, one in train and the other in val or test, that are the same or almost."""
    from pyspark.sql import functions as F

    from spanloom.llm.overlap import cross_split_pairs

    pairs = cross_split_pairs(table(spark, sf_dir, "code_files"), table(spark, sf_dir, "file_split"))
    return pairs.select(F.least("eval_file", "train_file").alias("file_a"), F.greatest("eval_file", "train_file").alias("file_b")).distinct()


def p2_report(spark, sf_dir):
    """Their number per split and repository of the evaluation file."""
    from spanloom.llm.overlap import overlap_report

    return overlap_report(table(spark, sf_dir, "code_files"), table(spark, sf_dir, "file_split"))


def p3_found(spark, sf_dir):
    """Credentials in contents, record values and notes."""
    from spanloom.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "code_files"))


def p3_redacted(spark, sf_dir):
    """The strings that hold credentials, with a placeholder in the place of each."""
    from spanloom.llm.redact import redacted_strings
    from spanloom.llm.secrets import secret_spans

    files = table(spark, sf_dir, "code_files")
    return redacted_strings(files, secret_spans(files))


def p4_found(spark, sf_dir):
    """Files that nobody wrote by hand here."""
    from spanloom.llm.origin import foreign_files

    return foreign_files(table(spark, sf_dir, "code_files")).select("fileId")


def p5_found(spark, sf_dir):
    """Languages of the running prose in comments and literals of each file."""
    from spanloom.llm.prose import file_languages

    return file_languages(table(spark, sf_dir, "code_files")).select("fileId", "lang")


def p5_shares(spark, sf_dir):
    """The words of each of these languages and their share of the file's bytes."""
    from spanloom.llm.prose import file_languages

    return file_languages(table(spark, sf_dir, "code_files"))


def p6_found(spark, sf_dir):
    """Personal information in contents, record values and notes."""
    from spanloom.llm.personal import personal_spans

    return personal_spans(table(spark, sf_dir, "code_files"))


def p6_redacted(spark, sf_dir):
    """The strings that hold personal information, with the type of each in its place."""
    from pyspark.sql import functions as F

    from spanloom.llm.personal import personal_spans
    from spanloom.llm.redact import redacted_strings

    files = table(spark, sf_dir, "code_files")
    spans = personal_spans(files).withColumn("word", F.concat(F.lit("<"), F.upper("piiType"), F.lit(">")))
    return redacted_strings(files, spans, "word")


def p7_ids(spark, sf_dir):
    from spanloom.llm.tokenize import encode_column

    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_windows(spark, sf_dir):
    """The ids with their offsets and the text of each run of 128 ids, found through the offsets."""
    from spanloom.llm.tokenize import decode_windows, encode_column

    return decode_windows(encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", offsets=True), "doc_id", 128)


def p8_found(spark, sf_dir):
    from spanloom.llm.contain import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    """Documents whose text was cut before its end."""
    from spanloom.llm.cut import cut_texts

    return cut_texts(table(spark, sf_dir, "documents")).select("doc_id")


def p9_rates(spark, sf_dir):
    """How often each source cuts."""
    from spanloom.llm.cut import truncation_rates

    return truncation_rates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_report, p3_found, p3_redacted, p4_found, p5_found, p5_shares, p6_found, p6_redacted, p7_ids, p7_windows, p8_found, p9_found, p9_rates)}

SQL: dict[str, str] = {}
