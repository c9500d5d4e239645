"""p1_found: wrongly decoded passages."""

import pytest

from spanloom.llm.encoding import Model, garble, mend_files, repaired, restore
from tests.llm.helpers import DE, EN, ODD, files

FR = "La tâche planifiée libère le numéro de série après le redémarrage, même en cas de forte charge."
RU = "Следующий ключ освобождает временный файл, пока никто не пишет. Старый буфер создаёт новый список."
ZH = "默认配置生成空字符串，在下次重试之前。临时文件保存旧的归档，因为旧格式中没有它。"
JA = "一時ファイルを短縮して経路表を最後に閉じる。選択した領域を先に確認する。"
ALL = [DE, FR, RU, ZH, JA]


@pytest.fixture(scope="module")
def model():
    return Model([s.strip() + "." for t in ALL for s in t.split(".") if s.strip()] * 20)


def pairs_used(model, text):
    ((at, states),) = model.label([text])
    return {model.names[s] for s in states.tolist()} - {("clean", "clean")}, at, states


@pytest.mark.parametrize("text", [EN, *ALL, "Ελληνικό κείμενο χωρίς λάθη, με τόνους.", "עברית תקינה לגמרי", "naïve café, Łukasz Dvořák and Zoë © 2020", "x → y • z … “ok”", "🏴‍☠️ 漢字かな"])
def test_clean_text_is_clean(model, text):
    assert pairs_used(model, text)[0] == set()


@pytest.mark.parametrize(
    ("text", "true", "read"),
    [(DE, "utf-8", "latin-1"), (FR, "utf-8", "cp1252"), (DE, "utf-8 twice", "cp1252"), (FR, "utf-8", "mac-roman"), (DE, "utf-8", "cp437"), (FR, "cp1252", "mac-roman"), (DE, "cp1252", "cp437"), (FR, "cp1252", "cp1251"), (RU, "utf-8", "cp1251"), (RU, "cp1251", "latin-1"), (RU, "koi8-r", "cp1251"), (RU, "utf-8", "cp866"), (ZH, "gb18030", "latin-1"), (ZH, "utf-8", "latin-1"), (JA, "cp932", "cp1252"), (JA, "euc-jp", "latin-1")],
)
def test_round_trip(model, text, true, read):
    bad = garble(text, true, read)
    assert restore(bad, true, read) == text
    found, at, states = pairs_used(model, f"x = 1\n# {bad}\ny = 2\n")
    assert found
    fixed, whole = repaired(f"x = 1\n# {bad}\ny = 2\n", at, states, model.names)
    assert whole and fixed == f"x = 1\n# {text}\ny = 2\n"


def test_lost_bytes_are_found_but_not_restored(model):
    bad = garble(DE, "cp1252", "utf-8")
    found, at, states = pairs_used(model, bad)
    assert found and repaired(bad, at, states, model.names) == (bad, False)


def test_only_some_lines(spark, model):
    text = f"# {FR}\n# {garble(FR, 'utf-8', 'latin-1')}\nx = 'Zoë'\n"
    rows = [(1, "a.py", text, "r"), (1, "a.py", text, "r"), (2, "b.py", f"# {FR}\n", "r"), (3, "c.py", "# " + garble(DE, "utf-8", "latin-1") * 300, None), *ODD]
    out = {r.fileId: r for r in mend_files(files(spark, rows).withColumnRenamed("repoName", "pairs"), model=model).collect()}
    assert set(out) == {1, 3} and out[1].restorable and out[1].content == f"# {FR}\n# {FR}\nx = 'Zoë'\n"
    assert out[1].pairs == ["utf-8 read as latin-1"]
    assert mend_files(files(spark, [])).count() == 0
