"""Small tables for the tests of this folder."""

FILES = "fileId long, path string, content string, repoName string, extension string, piiRecords array<struct<piiId: int, piiType: string, location_start: int, location_end: int, value: string, notes: string>>"


def files(spark, rows):
    """rows: (fileId, path, content, repoName[, records])."""
    full = [(k, p, c, r, (p or "").rpartition(".")[2] or None, (rest or [None])[0]) for k, p, c, r, *rest in rows]
    return spark.createDataFrame(full, FILES)


ODD = [(901, None, None, None), (902, "a.py", "", "r"), (903, "b.py", "  \n\t", None), (904, "c.java", "﻿", "r"), (905, None, "x", None)]
EN = "The outer reader holds the inner queue while the writer waits for the next block. After a restart the queue is empty and no entry is lost."
DE = "Der äußere Leser hält die innere Schlange, während der Schreiber auf den nächsten Block wartet. Nach einem Neustart ist die Schlange für alle Leser leer."
