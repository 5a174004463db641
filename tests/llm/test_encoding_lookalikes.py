from __future__ import annotations

import pytest

from quire.llm import encoding as en
from quire.llm import lookalikes as la

FRENCH = "Le médecin de la forêt a oublié la clé dorée près du château, où l'été était déjà gelé. Le curé cherchait là-bas sa fenêtre, après le dîner. Français, garçon, naïve, cœur, maîtresse, brûlé."
GERMAN = "Der Müller fürchtete die Straße; während der Nacht grüßte die Köchin das Mädchen. Überall hörte man schöne Märchen über große Häuser und Bäume."
RUSSIAN = "Старый садовник вспомнил письмо из города. Гостья забыла зеркало в саду, у окна. Учительница читает дневник после ужина, писарь нашёл ключ в темноте."
JAPANESE = "夜明け前に、隣人は鐘を失くした。先生は橋を直した。川のほとりで、少年はノートを開けた。"
PORTUGUESE = "A mãe levou a lã à venda pela manhã; o irmão não viu a maçã. A LÃ, A MAÇÃ E A MANHÃ: Âge e Âmbar."
ENGLISH = "“The café closed at noon,” said Zoë… “and yet the fiancé returned – Héloïse’s façade!” A 5° cut; © 307. Cost: €5, £383, ¥532."


@pytest.fixture(scope="module")
def restorer():
    texts = []
    for lang, t in (("fr", FRENCH), ("de", GERMAN), ("ru", RUSSIAN), ("ja", JAPANESE), ("en", ENGLISH), ("pt", PORTUGUESE)):
        parts = t.split(" ")
        texts += [(lang, " ".join(parts[i:] + parts[:i])) for i in range(0, len(parts), max(1, len(parts) // 8))] * 4
    return en.Restorer(en.Model.fit(texts))


def _garble(text, *steps):
    for read, written in steps:
        out = []
        for b in text.encode(written):
            try:
                out.append(bytes([b]).decode(read))
            except UnicodeDecodeError:
                out.append(chr(b))
        text = "".join(out)
    return text


@pytest.mark.parametrize(
    ("text", "steps"),
    [
        (FRENCH, [("cp1252", "utf-8")]), (FRENCH, [("latin-1", "utf-8")]), (FRENCH, [("cp437", "utf-8")]), (FRENCH, [("mac_roman", "utf-8")]), (GERMAN, [("cp1251", "utf-8")]), (GERMAN, [("cp850", "utf-8")]),
        (FRENCH, [("cp1252", "utf-8"), ("cp1252", "utf-8")]), (GERMAN, [("mac_roman", "cp1252")]), (GERMAN, [("cp437", "cp1252")]), (RUSSIAN, [("cp1252", "utf-8")]), (RUSSIAN, [("cp1252", "cp1251")]), (RUSSIAN, [("cp1251", "koi8_r")]), (RUSSIAN, [("cp1251", "cp866")]), (JAPANESE, [("cp1252", "utf-8")]), (ENGLISH, [("cp1252", "utf-8")]),
    ],
)
def test_chains_are_undone(restorer, text, steps):
    bad = _garble(text, *steps)
    assert bad != text
    now, chain = restorer.restore(bad)
    assert chain is not None
    a, b = now.split(), text.split()
    assert len(a) == len(b) and sum(x == y for x, y in zip(a, b, strict=True)) >= 0.9 * len(b)


def test_parts_are_restored_and_the_rest_stays(restorer):
    half = FRENCH.split(". ")
    mixed = f"{half[0]}. {_garble(half[1], ('cp1252', 'utf-8'))}"
    now, chain = restorer.restore(mixed)
    assert chain == "utf_8>cp1252" and now == f"{half[0]}. {half[1]}"


def test_every_chain_of_a_text_is_undone(restorer):
    steps = [("cp1252", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("koi8_r", "utf-8"), ("cp866", "utf-8"), ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866")]
    parts = [" ".join([RUSSIAN] * (len(steps) - i)) for i in range(len(steps))]  # the last chain has the fewest words
    now, chain = restorer.restore(" ".join(_garble(p, s) for p, s in zip(parts, steps, strict=True)))
    assert len(chain.split("|")) > 6
    a, b = now.split(), " ".join(parts).split()
    last = len(RUSSIAN.split())
    assert len(a) == len(b) and sum(x == y for x, y in zip(a[-3 * last :], b[-3 * last :], strict=True)) >= 0.9 * 3 * last


def test_results_do_not_depend_on_the_memory(restorer, monkeypatch):
    steps = [("cp1252", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8")]
    texts = [_garble(t, s) for t in (FRENCH, GERMAN, RUSSIAN) for s in steps] + [FRENCH, RUSSIAN, " ".join(_garble(FRENCH, s) for s in steps)]
    results = []
    for words in (1, 20, 10**9):
        monkeypatch.setattr(en, "MEMO_WORDS", words)
        restorer.memo.clear()
        results.append([(restorer.restore(t), restorer.lost(t)) for t in texts])
    assert results[0] == results[1] == results[2] and sum(chain is not None for (_, chain), _ in results[0]) == 10


def test_another_encoding_before_utf8_is_undone(restorer):
    bad = _garble(RUSSIAN, ("cp1252", "cp1251"), ("cp1252", "utf-8"))
    now, chain = restorer.restore(bad)
    assert "utf_8>cp1252+cp1251>cp1252" in chain
    assert sum(x == y for x, y in zip(now.split(), RUSSIAN.split(), strict=True)) >= 0.9 * len(RUSSIAN.split())


@pytest.mark.parametrize("text", [FRENCH, GERMAN, RUSSIAN, JAPANESE, ENGLISH, FRENCH.upper(), "A LÃ: 527. Âge: 35.", "© 298 ¤ 673", "CAFÉ» là", "plain", "", " "])
def test_sound_texts_stay(restorer, text):
    assert restorer.restore(text) == (text, None) and not restorer.lost(text)


def test_lost(restorer):
    assert restorer.lost("caf�") and restorer.lost("x\x9d") and not restorer.lost("“ok” Ã la")


def test_operator_cases(spark):
    docs = spark.createDataFrame([("fr", FRENCH), ("de", GERMAN), ("xx-1", "x"), (None, FRENCH), ("ru", None)], "lang string, text string")
    model = en.fit(docs)
    assert set(model.dictionaries) == {"fr", "de"}
    bad = _garble(FRENCH, ("cp1252", "utf-8"))
    df = spark.createDataFrame([("t", 1, bad, 0), ("t", 1, bad, 0), ("t", 2, None, 0), ("t", 3, "", 0), ("t", 4, FRENCH * 50, 0)], "table_name string, row_id int, text string, garbled int")
    rows = en.restore(df, model).collect()
    assert [(r.row_id, r.garbled) for r in sorted(rows, key=lambda r: r.row_id)] == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert all(r.restored == r.text for r in rows if not r.garbled)
    assert en.restore(df, model, only_garbled=True).count() == 2 and en.restore(df.limit(0), model).count() == 0
    empty = en.fit(docs.limit(0))
    assert en.restore(df, empty).count() == 5


def test_the_model_counts_all_texts(spark):
    """However many and however long they are."""
    from collections import Counter

    texts = [f"L'été {n:03d} {chr(0x100 + n // 9)}{chr(0x100 + n % 9)}" for n in range(900)] + ["œuvre ñ " * 600, "ÿ"]
    model = en.fit(spark.createDataFrame([("fr", t) for t in texts], "lang string, text string").repartition(3))
    assert model.letters == Counter(c for t in texts for c in t.replace(" ", ""))
    words = [f" {en._digits(w)} " for t in texts for w in t.split()]
    assert model.pairs == Counter(a + b for w in words for a, b in zip(w, w[1:], strict=False))
    assert model == en.Model.fit([("fr", t) for t in texts])


def test_a_few_garbled_texts_do_not_make_garble_known(spark):
    texts = [FRENCH] * 2500 + [_garble("clé", ("cp1252", "utf-8"))]
    model = en.fit(spark.createDataFrame([("fr", t) for t in texts], "lang string, text string"))
    assert "Ã©" not in model.pairs and model.pairs["té"] == FRENCH.count("té") * 2500


def test_names_known_with_a_capital_are_not_odd_without():
    r = en.Restorer(en.Model.fit([("en", "Ångholm met Étienne.")]))
    assert not r.odd("ångholm") and not r.odd("étienne") and r.odd("åtholm") and r.odd("mångholm")


FORMS = {
    "\uff34\uff4f\uff4c\uff56\uff01": "Tolv!", "cafe\u0301": "caf\xe9", "a\u200bb\ufeffc\xad": "abc", "a\xa0b\u3000c\u2009d": "a b c d", "\ufb01ne \u017fo \u0261ood": "fine so good", "Beatri\u0445": "Beatrix", "пр\x6fдала": "продала",
    "\U0001d40b\U0001d5fc\U0001d69b": "Lor", "\u2160t": "It", "\u30ab\u3099": "\u30ac", "h\u0456\u0455": "his", "\u03bfld": "old",
}
PLAIN = ["caf\xe9 \u201cx\u201d \u2013 \u2014 \u2026 \xa9 \u21165 \xbd", "у окна Wexvane", "天气\uff0c好\uff01", "Chapter \u2163.", "line\nbreak\ttab", "n\xb0 \xaa \xba \xb2"]


def test_one_form(spark):
    texts = [*FORMS, *PLAIN, "", None]
    df = spark.createDataFrame([("t", i, t, "x") for i, t in enumerate(texts)], "table_name string, row_id int, text string, form string")
    rows = sorted(la.one_form(df).collect(), key=lambda r: r.row_id)
    assert {r.text: r.form for r in rows[: len(FORMS)]} == FORMS
    assert [(r.form, r.changed) for r in rows[len(FORMS) :]] == [(t, False) for t in [*PLAIN, "", None]]
    assert all(r.changed for r in rows[: len(FORMS)])
    again = la.one_form(la.one_form(df).select("table_name", "row_id", F_form()))
    assert not again.where("changed").count()
    assert la.one_form(df, only_changed=True).count() == len(FORMS) and la.one_form(df.limit(0)).count() == 0


def F_form():
    from pyspark.sql import functions as F

    return F.col("form").alias("text")


def test_words_have_the_same_form():
    for w, form in FORMS.items():
        if " " not in form and w[-1] != "\uff01" and w != "\u2160t":
            assert la.plain_form(w) == form


def test_an_accent_that_does_not_compose_is_a_case(spark):
    df = spark.createDataFrame([("t", 1, "x\u0302 y")], "table_name string, row_id int, text string")
    assert la.one_form(df, only_changed=True).count() == 1


def test_further_scripts_and_signs(spark):
    rows = {1: ("\u043c\u03bf\u0441\u0442", "\u043c\u043e\u0441\u0442"), 2: ("\u03bb\u043e\u03b3\u03bf\u03c2", "\u03bb\u03bf\u03b3\u03bf\u03c2"), 3: ("\uff76\uff9e\uff61", "\u30ac\u3002"), 4: ("a\ufe0eb\u3164c", "abc"), 5: ("\u043c\u043e\u0441\u0442 \u03bb\u03bf\u03b3\u03bf\u03c2", "\u043c\u043e\u0441\u0442 \u03bb\u03bf\u03b3\u03bf\u03c2")}
    df = spark.createDataFrame([("t", k, v[0]) for k, v in rows.items()], "table_name string, row_id bigint, text string")
    got = {r.row_id: (r.form, r.changed) for r in la.one_form(df).collect()}
    assert got == {k: (want, want != text) for k, (text, want) in rows.items()}
