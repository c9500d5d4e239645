"""p4_found: files that nobody wrote by hand."""

import pytest

import __spark_entry__
from spanloom.llm.origin import DATA, GENERATED, MINIFIED, THIRD_PARTY, foreign_files, origin
from tests.llm.helpers import ODD, files

CODE = "class A {\n    int size() {\n        return part.size();\n    }\n}\n"


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("src/A.java", "// Code generated by tool 3. DO NOT EDIT.\n" + CODE, GENERATED),
        ("src/A.java", CODE + "// <auto-generated> tool </auto-generated>\n", GENERATED),
        ("src/A.java", '@Generated(value = "tool")\n' + CODE, GENERATED),
        ("src/A.java", 'String banner = "Code generated by tool. DO NOT EDIT.";\n' + CODE, None),
        ("src/A.c", '#define BANNER "Code generated by tool. DO NOT EDIT."\nint x;\n', None),
        ("src/A.java", "// the code generator asks vendors for their names\n" + CODE, None),
        ("src/main/java/com/x/vendor/A.java", CODE, None),
        ("src/main/java/com/x/generated/A.java", CODE, None),
        ("build/generated/x/A.java", CODE, GENERATED),
        ("web/node_modules/x/a.js", CODE, THIRD_PARTY),
        ("vendor/x/src/A.java", CODE, THIRD_PARTY),
        ("src/A.java", "# vendored copy of lib@12, do not patch here\n" + CODE, THIRD_PARTY),
        ("js/a.js", "/*! lib v1.2.3 | MIT */\n" + CODE, THIRD_PARTY),
        ("js/a.js", "!function(a){" + "b.c=function(d){return d.e(a)};" * 40 + "}\n", MINIFIED),
        ("src/a.py", "t = [\n" + "0x47, 0xb5, 0x82, 0x00,\n" * 20 + "]\n", DATA),
        ("src/a.py", "t = '" + "q" * 900 + "'\n" + "def f(x):\n    return x + 1\n" * 20, None),
        ("conf/a.json", '{\n"a": 1,\n"b": 2,\n"c": 3,\n"d": 4\n}\n', None),
        ("web/node_modules/x/a.js", "", None),
        (None, None, None),
    ],
)
def test_origin(path, content, want):
    assert origin(path, content) == want


def test_rows_and_odd_ones(spark):
    rows = [(1, "gen/a_pb2.py", "x = 1\n", "r"), (1, "gen/a_pb2.py", "x = 1\n", "r"), (2, "src/a.py", "x = 1\n", "r"), *ODD]
    out = foreign_files(files(spark, rows).withColumnRenamed("repoName", "origin")).collect()
    assert [(r.fileId, r.origin) for r in out] == [(1, GENERATED)]
    assert foreign_files(files(spark, [])).count() == 0


def test_registered():
    assert "p4_found" in __spark_entry__.queries()
