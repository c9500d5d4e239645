"""p5_found: natural language in comments and literals."""

import pytest

from spanloom.llm import prose
from spanloom.llm.encoding import Model, garble
from spanloom.llm.prose import classify, file_languages, kind_of, spans
from tests.llm.helpers import DE, EN, ODD, files

FR = "La tâche planifiée libère le numéro de série après le redémarrage, même en cas de forte charge."
PT = "A sessão atual repete o código legado enquanto ninguém escreve, e o relatório não é atualizado."
ES = "La sesión caducada repite la petición vacía mientras nadie escribe, y el búfer no se borra."
RU = "Следующий ключ освобождает временный файл, пока никто не пишет в этот журнал."
ZH = "默认配置生成空字符串，在下次重试之前。临时文件保存旧的归档，因为旧格式中没有它。"
JA = "一時ファイルを短縮して経路表を最後に閉じる。選択した領域を先に確認する。"


@pytest.mark.parametrize(("lang", "text"), [("en", EN), ("de", DE), ("fr", FR), ("pt", PT), ("es", ES), ("ru", RU), ("zh", ZH), ("ja", JA)])
def test_languages(lang, text):
    assert classify(text)[0] == lang and classify(text)[1] > 10


@pytest.mark.parametrize("text", ["SELECT firstColumn, secondColumn FROM some_table WHERE x IN (1, 2)", "Created by Ann Miller on 3/4/2020", "config.server.port", "thanks to Ann Miller and Bob Ross", "TODO remove this", "/var/log/some/path/with/many/parts"])
def test_no_prose(text):
    assert classify(text) == (None, 0)


def test_extraction():
    c = 'int a; // one two\n// three four\nchar *s = "it // is a string";\n/* a block\n * of lines */\n'
    assert spans(c, kind_of("a.c", "c")) == ["one two three four", "it // is a string", "a block of lines"]
    py = 'x = 1  # a comment here\ndef f():\n    """A docstring\n    of two lines."""\n'
    assert spans(py, kind_of("a.py.orig", None)) == ["a comment here", "A docstring of two lines."]
    assert spans("<a><!-- some words here --></a>", kind_of("a.xml", "xml")) == ["some words here"]
    assert spans("note: some words here\n", kind_of("a.yml", "yml")) == ["some words here"]


def test_files(spark, monkeypatch):
    model = Model([DE, FR] * 20)
    header = "/* " + EN + " */\n"
    rows = [
        (1, "a.java", header + "int x;\n", "r"),
        (1, "a.java", header + "int x;\n", "r"),
        (2, "b.java", header + f'String s = "{DE}";\n', "r"),
        (3, "c.py", "# " + garble(DE, "utf-8", "latin-1") + "\n", "r"),
        (4, "d.py", "# only a few words\n", "r"),
        (5, "e.py", f"# {ZH}\n" * 3 + "x = 1\n" * 20_000, None),
        *ODD,
    ]
    for hot in (prose.HOT, 1):  # labels of hot spans go another way, with the same result
        monkeypatch.setattr(prose, "HOT", hot)
        got = {(r.fileId, r.lang): r.share for r in file_languages(files(spark, rows).withColumnRenamed("repoName", "words"), model).collect()}
        assert set(got) == {(1, "en"), (2, "en"), (2, "de"), (3, "de"), (5, "zh")}
        assert 0.8 < got[1, "en"] < 1 and got[5, "zh"] < 0.1
    assert file_languages(files(spark, []), model).count() == 0
