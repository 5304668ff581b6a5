import random

from colophon.llm import mojibake as M

CLEAN = {
    "de": "Die Größe der Prüfung wächst über mehrere Jahre, während die Gefäße für ältere Kühe ähnlich bleiben.", "fr": "La forêt près des frontières où l'élève dépasse la température élevée après l'été.",
    "pl": "Źródło błędu wyjaśnia głębokość i gęstość próby, ponieważ język mieszkańców różni się między wiosną a jesienią.", "ru": "Структура населения в северных районах зависит от температуры после долгой зимы.",
    "ja": "過去の記録に基づき、粒子の密度は徐々に観測誤差を上回る。", "pt": "A população não supõe então a relação até a última seção em três estações.", "en": "A naïve façade – the reviewer’s point – measures ±0.5 °C and 12 µm².",
}
DAMAGE = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("pt", "utf-8", "cp437"), ("de", "mac-roman", "cp1252"), ("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "latin-1"), ("ja", "shift_jis", "latin-1"), ("pl", "iso8859-2", "latin-1"), ("pl", "utf-8", "cp1250"), ("en", "utf-8", "mac-roman")]


def corpus():
    rnd, rows = random.Random(3), []
    for lang, text in CLEAN.items():
        words = text.split(" ")
        for _ in range(80):
            rows.append((len(rows), " ".join(rnd.choice(words) for _ in range(30)) if lang != "ja" else text * 3))
    return rows


def damage(text, right, wrong):
    data = text.encode(right, "ignore")
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in data)


def test_repair_restores_and_leaves_clean_text(spark):
    clean = corpus()
    bad = [(1000 + n, damage(CLEAN[lang], right, wrong)) for n, (lang, right, wrong) in enumerate(DAMAGE)]
    bad.append((1100, damage(damage(CLEAN["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")))
    bad.append((1200, "Caf� na�ve"))
    extra = [(2000, None), (2001, ""), (2002, "  \n")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in clean + bad + extra], "doc_id bigint, text string, chains string")
    got = {r.doc_id: r for r in M.repair(docs, M.train(docs)).collect()}
    assert set(got) == {i for i, _ in bad}
    for n, (lang, right, _) in enumerate(DAMAGE):
        want = CLEAN[lang].encode(right, "ignore").decode(right)
        assert got[1000 + n].restored == want, DAMAGE[n]
    assert got[1100].restored == CLEAN["fr"] and not got[1200].restorable


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert M.repair(docs, M.train(docs)).count() == 0
