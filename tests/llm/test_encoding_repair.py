import difflib
import random
from collections import Counter

import pytest

from cairnfold.llm.encoding_repair import Model, damaged_documents, judge, judged_stretches, readings, restore, restored_documents, stretches, to_bytes, viterbi

LINES = [
    "Corrige la boîte à idées après l’échec du relevé", "Überprüfe die Größe der Einträge im Menü", "Elimina la señal de cierre y el número de línea",
    "Проверить порядок разбора заявок на складе", "Přesuň špatný název uzlu při prázdném souboru", "削除:古い経路の設定、遅い返事に備えて",
    "Drop the “quiet hours” switch — seen twice on the naïve rig …", "Não ignora a opção de duração da sessão", "Â, â and Î are letters of the alphabet: pâin",
    "plain ASCII text only", "├── crates │ └── quay", "l’entrée du café", "修复申请的排列顺序，以免丢失记录",
]


def _corpus(seed=0, n=600):
    r = random.Random(seed)
    return ["\n".join(r.choice(LINES) for _ in range(4)) for _ in range(n)]


DAMAGE = [
    (0, "utf-8", "latin-1"), (1, "utf-8", "cp1252"), (2, "utf-8", "mac-roman"), (3, "utf-8", "koi8-r"), (3, "cp1251", "latin-1"), (3, "utf-8", "cp1251"),
    (1, "utf-8", "cp437"), (4, "cp1250", "latin-1"), (5, "euc-jp", "latin-1"), (12, "gbk", "latin-1"), (0, "utf-8", "cp850"), (7, "utf-8", "cp1252"),
]


def _through(text, right, wrong):
    return "".join(bytes([b]).decode(wrong, "strict") if wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode(right, "ignore"))


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, stretch string, score double")


def test_damaged_documents_are_found_and_restored(spark):
    texts = _corpus()
    clean = len(texts)
    want = []
    for k, right, wrong in DAMAGE:
        texts.append(LINES[9] + "\n" + _through(LINES[k], right, wrong))
        want.append(LINES[9] + "\n" + LINES[k].encode(right, "ignore").decode(right))
    texts += [LINES[2].encode("latin-1").decode("utf-8", "replace"), "日本" + LINES[9].encode("utf-16-le").decode("utf-16-be"), "﻿".encode().decode("latin-1") + "x"]
    texts += [None, "", " ", "\\303\\251 caf\\xc3\\xa9 =C3=A9 &eacute;", "é" * 20_000, "word " * 50_000]
    rows = {x.doc_id: x for x in restored_documents(_frame(spark, texts)).collect()}
    assert set(rows) == set(range(clean, clean + len(DAMAGE) + 3))
    right = sum(rows[clean + i].restored == w for i, w in enumerate(want))
    assert right == len(want)
    assert LINES[9] in rows[clean + len(DAMAGE) + 1].restored
    assert rows[clean + len(DAMAGE)].restored == LINES[2]


def test_found_once_and_the_same_by_a_join(spark):
    texts = [*_corpus(1, 200), _through(LINES[0], "utf-8", "latin-1")]
    df = _frame(spark, texts)
    a = [x.doc_id for x in damaged_documents(df.union(df)).collect()]
    b = [x.doc_id for x in damaged_documents(df, broadcast_bytes=0).collect()]
    assert a == b == [200]


def test_empty_table(spark):
    assert damaged_documents(_frame(spark, [])).count() == 0
    assert restored_documents(_frame(spark, [None, ""])).count() == 0


def test_lost_bytes_are_filled():
    model = Model({"número": 50, "señal": 40, "línea": 30, "él": 5})
    assert restore("n�mero de l�nea", "utf-8", "lost", model)[0] == "número de línea"
    data = list("señal".encode())
    data[3] = None
    assert viterbi(data, "utf-8", model) == ("señal", 0.0)


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "koi8-r", "cp437", "gbk"])
def test_bytes_come_back(wrong):
    text = "déjà vu".encode().decode("latin-1" if wrong == "latin-1" else wrong, "replace")
    lattice = to_bytes(text, wrong)
    assert lattice is not None
    if "�" not in text:
        assert bytes(lattice) == "déjà vu".encode()
        assert any(out == "déjà vu" for w, _, out, _ in readings(text) if w == wrong)


def test_stretches_cover_everything_beyond_ascii():
    text = "ab é" + "x" * 200 + "ü\n" + "日" * 130 + " “q” ©"
    covered = set()
    for a, b in stretches(text):
        covered |= set(range(a, b))
    assert {i for i, c in enumerate(text) if not c.isascii()} <= covered


def test_common_damage_is_judged_like_rare_damage(spark):
    for times in (1, 10, 1000):  # the same corpus, so many times over
        model = Model({"–": 2415 * times, "“": 900 * times, "é": 40 * times, "ñ": 3 * times})
        types = spark.createDataFrame([(w, n) for w, n in model.words.items()], "stretch string, n long")
        found = {(x.stretch, x.wrong, x.right) for x in judged_stretches(types, model).collect()}
        assert {x[0] for x in found} == {"ñ"}
        assert ("ñ", "mac-roman", "cp1252") in found


def test_damaged_documents_do_not_depend_on_the_number_of_copies(spark):
    texts = [*["the brig – the quay"] * 2000, *["naïve"] * 40, *["the brig ñ the quay"] * 2]
    for times in (1, 12):
        found = damaged_documents(_frame(spark, texts * times)).collect()
        assert len(found) == 2 * times
        assert {texts[x.doc_id % len(texts)] for x in found} == {texts[-1]}


def test_common_words_with_signs_are_no_damage():
    words = {"“quiet": 2350, "didn’t": 1945, "¿quizá": 332, "Удали": 300, "Убери": 300, "é": 400}
    model = Model(words)
    assert not [w for w in words if judge(w, model)]


@pytest.mark.parametrize("right, wrong", [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "koi8-r"), ("utf-8 twice", "latin-1"), ("gbk", "latin-1")])
def test_long_stretches_come_back_whole(right, wrong):
    words = {w: 50 for line in (LINES[3], LINES[12]) for w in line.replace("，", " ").split()} | {"，": 40, "порядок": 60}
    model = Model(words)
    base = LINES[12].replace("，", "") * 9
    for lead in range(3):  # the old cuts then fall elsewhere in a character
        want = base[lead:] if right == "gbk" else "é" * lead + base
        damaged = want
        for _ in range(1 + (right == "utf-8 twice")):
            damaged = damaged.encode(right.split()[0]).decode(wrong)
        assert restore(damaged, wrong, right, model)[0] == want


def _back(data, wrong):
    out = ""
    for b in data:
        try:
            out += bytes([b]).decode(wrong)
        except UnicodeError:
            out += chr(b)
    return out


PAIRS = [(w, "utf-8", (0, 1, 2, 3, 4, 6, 7)) for w in ("latin-1", "cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1254", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "cp852", "mac-roman")] + [
    ("latin-1", "cp1251", (3,)), ("latin-1", "koi8-r", (3,)), ("latin-1", "cp1250", (4,)), ("latin-1", "gbk", (12,)), ("latin-1", "euc-jp", (5,)),
    ("cp1252", "mac-roman", (0, 1, 2, 7)), ("mac-roman", "cp1252", (0, 1, 2, 7)), ("cp437", "latin-1", (0, 1, 2, 7)),
]


@pytest.mark.parametrize("lost, least", [(0, 1.0), (1, 0.95), (2, 0.9), (3, 0.9)])
def test_accuracy_of_restored_texts_with_lost_bytes(lost, least):
    """Known texts through every channel, with bytes lost on the way: share of words, and of characters, that come back."""
    words = Counter()
    for line in LINES:
        for a, b in stretches(line):
            words[line[a:b]] += 50
    model, r = Model(dict(words)), random.Random(lost)
    right_words = all_words = right_signs = all_signs = 0
    for wrong, right, lines in PAIRS:
        for k in lines:
            want = LINES[k].encode(right, "ignore").decode(right)
            damaged = list(_back(want.encode(right), wrong))
            beyond = [i for i, c in enumerate(damaged) if not c.isascii()]
            for i in r.sample(beyond, min(lost, len(beyond))):
                damaged[i] = "\ufffd"
            got = restore("".join(damaged), wrong, right, model)[0]
            # a word counts in full, whatever was lost in it
            each = difflib.SequenceMatcher(None, want.split(" "), got.split(" "), autojunk=False).get_matching_blocks()
            right_words, all_words = right_words + sum(x.size for x in each), all_words + len(want.split(" "))
            each = difflib.SequenceMatcher(None, want, got, autojunk=False).get_matching_blocks()
            right_signs, all_signs = right_signs + sum(x.size for x in each), all_signs + len(want)
    print(f"{lost} lost: words {right_words / all_words:.4f}, characters {right_signs / all_signs:.4f}")
    assert right_words / all_words >= least
    assert right_signs / all_signs >= least


def test_what_one_channel_leaves_is_read_by_another(spark):
    texts = _corpus(3)
    want = [LINES[k] for k in (0, 1, 7, 3)]
    texts.append("\n".join(_through(w, "utf-8", c) for w, c in zip(want, ("latin-1", "latin-1", "latin-1", "koi8-r"), strict=True)))
    rows = restored_documents(_frame(spark, texts)).collect()
    assert [x.doc_id for x in rows] == [len(texts) - 1]
    assert rows[0].restored == "\n".join(want)


def test_utf_16_read_by_bytes(spark):
    texts = [*_corpus(4, 200), LINES[9].encode("utf-16-le").decode("latin-1"), "a\0b", LINES[9].encode("utf-16-be").decode("latin-1")]
    rows = {x.doc_id: x.restored for x in restored_documents(_frame(spark, texts)).collect()}
    assert rows == {200: LINES[9], 202: LINES[9]}


def test_many_words_are_counted_exactly(spark):
    """Words that the search does not know are known to the judge."""
    texts = [*_corpus(5, 300), *[f"le mot é{chr(97 + i % 26)}{chr(97 + i // 26)}tre ici" for i in range(200)] * 2]
    texts.append(_through(LINES[0], "utf-8", "latin-1"))
    for top_words in (0, 50_000):
        assert [x.doc_id for x in damaged_documents(_frame(spark, texts), top_words=top_words).collect()] == [len(texts) - 1]


def test_parts_of_characters_at_the_ends_stay():
    model = Model({w: 50 for w in LINES[3].split()} | {"Проверитьпорядок": 20})
    want = "Проверитьпорядок" * 10
    damaged = want.encode().decode("latin-1")
    assert restore(damaged[1:], "latin-1", "utf-8", model)[0] == damaged[1] + want[1:]
    assert restore(damaged[:-1], "latin-1", "utf-8", model)[0] == want[:-1] + damaged[-2]
    assert restore("日" + damaged, "latin-1", "utf-8", model)[0] == "日" + want
