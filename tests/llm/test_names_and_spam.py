import random

import pytest

from tracequarry.llm import encoding_repair as er
from tracequarry.llm import spam

WORDS = "Übersicht Verträge Schlüssel Příloha Červen Řešení Réunion Société Número Configuración Проверка Документ Настройка Αρχείο Σύμβαση 設定 記録 予算 図面 Źródło Część Değer Şifre Coração Versão".split()
CHAINS = [[("utf-8", "cp1252*")], [("utf-8", "latin-1")], [("utf-8", "cp437")], [("utf-8", "cp1252*"), ("utf-8", "cp1252*")], [("utf-8", "cp1251")], [("utf-8", "mac_roman")]]
LEGACY = {"Př": "cp1250", "Če": "cp1250", "Ře": "cp1250", "Пр": "cp1251", "До": "cp1251", "Αρ": "cp1253", "設定": "cp932", "予算": "cp932"}


def misread(text, chain):
    for right, wrong in chain:
        data = text.encode(right)
        table = er._table(wrong.rstrip("*"), wrong.endswith("*"))[1]
        if any(b not in table for b in data):
            return None
        text = "".join(table[b] for b in data)
    return text


@pytest.fixture(scope="module")
def names(spark):
    random.seed(5)
    rows, truth = [], {}
    for i in range(1500):
        a, b = random.choice(WORDS), random.choice(WORDS)
        rows.append((i, f"C:\\Data\\{a}_{b} {i % 90}.txt", "clash"))
    n = 1500
    for w in WORDS:
        for chain in CHAINS:
            bad = misread(f"{w}-{w}", chain)
            if bad:
                rows.append((n, f"\\\\?\\x\\{bad}\\y.txt", "clash"))
                truth[n] = f"\\\\?\\x\\{w}-{w}\\y.txt"
                n += 1
        codec = LEGACY.get(w[:2])
        if codec:
            rows.append((n, misread(w, [(codec, "cp1252*")]) + "\\z", "clash"))
            truth[n] = w + "\\z"
            n += 1
    for lost in ("Schl?ssel", "??????", "Vertr�ge"):
        rows.append((n, lost, "clash"))
        truth[n] = ""
        n += 1
    for clean in ("Ready?", "¿Listo?", "«Документ»", "Draft™", "══ Menu ══", "§ 5", "update.exe", "\\??\\C:\\a", "", None, "a" * 50_000 + "é"):
        rows.append((n, clean, "clash"))
        n += 1
    rows.append(rows[1500])
    df = spark.createDataFrame(rows, "id bigint, name string, restored string")
    return [(r[0], r[1]) for r in er.find_garbled(df, "name", ["id"]).collect()], truth


def test_garbled_names_are_restored(names):
    got, truth = names
    found = dict(got)
    wrong = {k: (found.get(k), v) for k, v in truth.items() if found.get(k) != v}
    assert len(wrong) <= 0.03 * len(truth), wrong


def test_clean_names_are_left(names):
    got, truth = names
    assert {k for k, _ in got} <= set(truth) and len(got) >= len(dict(got)) + 1  # the repeated row comes again


def test_every_pair_of_encodings_is_tried():
    for text, right, wrong in (("Αρχείο", "cp1253", "cp1250"), ("Αρχείο", "iso8859-7", "cp1250"), ("Değer", "cp1254", "cp1250"), ("문서", "cp949", "cp1250")):
        assert text in er.candidates(misread(text, [(right, wrong)])).values(), (right, wrong)


def test_half_characters_of_every_misreading():
    assert all(er._half_character("a" + misread("Ω", [("cp1253", wrong)])) for wrong in ("cp1252*", "cp437", "cp1251", "koi8-r"))
    assert not er._half_character("") and not er._half_character("abc")


def test_empty_table(spark):
    assert er.find_garbled(spark.createDataFrame([], "id bigint, name string"), "name", ["id"]).collect() == []


def test_buckets_agree_with_spark(spark):
    from pyspark.sql import functions as F

    grams = ["a", "é", "設定", "\x02пр", "ß\x03", "😀"]
    df = spark.createDataFrame([(g,) for g in grams], "g string")
    assert [r[0] for r in df.select(F.pmod(F.xxhash64("g"), F.lit(er.BUCKETS))).collect()] == [er.gram_bucket(g) for g in grams]


PROSE = "The second analyst read the {0} of the server and wrote that the {1} was damaged before the review, although nobody had opened it."
NOUNS = "disk image report cache table record script backup ledger copy driver shadow timeline".split()


def corpus():
    random.seed(8)
    good, bad = [], []
    for _ in range(160):
        good.append(" ".join(PROSE.format(random.choice(NOUNS), random.choice(NOUNS)) for _ in range(random.randint(3, 9))))
    good.append("\n".join(f"2024-01-0{1 + i % 9} 10:0{i % 10}:11 HOST-A{i} ERROR GET https://a{i}.test/x 200" for i in range(30)))
    good.append("\n".join(f"C:\\Windows\\System32\\file{i}.dll" for i in range(30)))
    good.append(good[0] + "\n\n[1] https://one.test/a\n[2] https://two.test/b")
    keys = ["cheap registry", "registry download", "free registry tool", "registry crack"]
    bad.append(", ".join(random.choice(keys) for _ in range(80)))
    bad.append("\n".join(f"{random.choice(keys)} https://x{i}.test/{i}" for i in range(40)))
    bad.append(" ".join(f"#{random.choice(NOUNS)}" for _ in range(90)))
    bad.append(good[1][:120] + ".\n\n" + " | ".join(random.choice(keys) for _ in range(120)))
    return good, bad


def test_spam_pages(spark):
    good, bad = corpus()
    rows = [(i, t, "en", "x") for i, t in enumerate(good)] + [(1000 + i, t, random.choice(["en", None, "und"]), "x") for i, t in enumerate(bad)]
    rows += [(2000, None, "en", "x"), (2001, "", "en", "x"), (2002, "  ", None, "x"), (2003, "ok", "en", "x"), (1000, bad[0], "en", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, spam string")
    got = sorted(r[0] for r in spam.spam_pages(df).collect())
    assert got == [1000, 1001, 1002, 1003]


def test_spam_of_core_words_is_found(spark):
    random.seed(9)
    good = [" ".join(PROSE.format(*random.sample(NOUNS, 2)) for _ in range(random.randint(2, 3))) for _ in range(200)]
    bad = [" | ".join(random.choice(["cache table", "cache driver", "top cache", "cache ledger"]) for _ in range(60)) for _ in range(4)]
    bad.append(", ".join(random.choice(["timeline", "timeline script", "cheap timeline"]) for _ in range(90)))
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    core = spam.core_words(df)["en"]
    assert {"the", "was", "disk"} <= set(core) and not {"cache", "timeline"} & set(core)
    assert sorted(r[0] for r in spam.spam_pages(df).collect()) == [200, 201, 202, 203, 204]


def test_high_core_share_is_no_verdict():
    judge = spam.Judge({"en": {"the": 0.9, "was": 0.6, "hive": 0.4}})
    page = " | ".join(["hive crack", "top hive", "hive hive"] * 20)
    assert judge.measure(page)[2] >= spam.PROSE_SHARE and judge.spam_part(page) > spam.GREATER_PART


def test_labels_do_not_hide_lists():
    judge = spam.Judge({"en": {"the": 0.9, "was": 0.6, "of": 0.8}})
    for label in ("keywords: ", "Tags: ", ""):
        assert judge.spam_part(label + " | ".join(["best hive viewer 8.3", "free hive viewer x64", "best hive crack"] * 4)) == 1.0
    assert judge.spam_part("title: Odd driver start\nlevel: high\ndescription: the name of the driver was wrong\nEventID: 4624") == 0.0


def test_short_spam(spark):
    good = [" ".join(PROSE.format(*random.sample(NOUNS, 2)) for _ in range(2)) for _ in range(60)]
    bad = ["#hive #crack #free #best #top", "hive hive hive cheap hive"]
    fine = ["see above", "n/a", "re: setup", "👍 done, thanks!", "trace85.pdf?"]
    df = spark.createDataFrame(list(enumerate(good + bad + fine)), "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    assert sorted(r[0] for r in spam.spam_pages(df).collect()) == [60, 61]


def test_spam_of_empty_table(spark):
    assert spam.spam_pages(spark.createDataFrame([], "doc_id bigint, text string, lang string")).collect() == []


def test_margin_is_validated_on_held_out_words(spark):
    random.seed(6)
    words = ["résumé", "señor", "überblick", "größe", "año", "français", "naïve", "ação", "coração", "señal", "über", "straße", "élève", "forêt", "niño", "mañana", "grün", "schön", "café", "olá"]
    words += [a + b for a in ("mé", "lö", "sã", "tü", "pê") for b in ("lange", "rado", "tion", "ler", "nia", "val", "dor", "ment")]
    names = [f"{random.choice(words)} {random.choice(words)}_{i}" for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    model = er.train(df, "name")
    assert sum(model.weights) <= 1.0 and min(model.weights) > 0 and model.margin in er.MARGINS
    import numpy as np

    counts = np.tile(model.counts / er.FOLDS, (er.FOLDS, 1))
    weights, margin, curve = er.validate(counts, np.full(er.FOLDS, model.total / er.FOLDS), [(w, [1] * er.FOLDS) for w in words])
    assert [c[0] for c in curve] == list(er.MARGINS)
    at = dict((c[0], c[1:]) for c in curve)
    assert at[margin][0] <= 0.02 and at[margin][1] + at[margin][2] <= 0.1
    assert all(a[1] >= b[1] and a[2] <= b[2] for a, b in zip(curve, curve[1:]))
    assert er.validate(counts, np.zeros(er.FOLDS), [])[1] == er.MARGIN


def test_the_margin_comes_from_all_words(spark):
    import numpy as np
    from pyspark.sql import functions as F

    random.seed(10)
    heads = ["mé", "lö", "sã", "tü", "pê", "ñu", "çe", "bå", "gø", "dì"]
    words = [a + b + c for a in heads for b in ("lan", "ra", "ti", "le", "ni", "val", "do", "men") for c in ("ge", "do", "on", "ler", "ia", "q")]
    df = spark.createDataFrame([(i, f"{w}_{i}") for i, w in enumerate(words)], "id bigint, name string")
    fold_of = dict(map(tuple, df.select("id", F.pmod(F.xxhash64("name", F.lit(1)), F.lit(er.FOLDS))).collect()))
    tables, totals = np.zeros((er.FOLDS, er.BUCKETS)), np.zeros(er.FOLDS)
    for i, w in enumerate(words):
        t = f"\x02{w}\x03"
        totals[fold_of[i]] += len(t)
        for k in (1, 2, 3):
            for j in range(len(t) - k + 1):
                tables[fold_of[i], er.gram_bucket(t[j : j + k])] += 1
    weights, margin, _ = er.validate(tables, totals, [(w, [int(fold_of[i] == k) for k in range(er.FOLDS)]) for i, w in enumerate(words)])
    model = er.train(df, "name")
    assert len(words) == 480 and model.weights == pytest.approx(weights, abs=1e-6) and model.margin == margin


def test_the_curve_counts_every_garbling_in_every_fold():
    import numpy as np

    random.seed(11)
    words = [(a + b, [random.randint(0, 3) for _ in range(er.FOLDS - 1)] + [1]) for a in ("é", "lö", "sã", "тю", "ð") for b in ("lan", "ra", "ti", "ð", "ñi", "val", "dø", "men", "q", "", "ß")]
    tables, totals = np.zeros((er.FOLDS, er.BUCKETS)), np.zeros(er.FOLDS)
    for w, folds in words:
        t = f"\x02{w}\x03"
        totals += np.array(folds) * len(t)
        for k in (1, 2, 3):
            for j in range(len(t) - k + 1):
                tables[:, er.gram_bucket(t[j : j + k])] += folds
    weights, _, curve = er.validate(tables, totals, words)
    models = [er.Model(tables.sum(axis=0) - tables[k], totals.sum() - totals[k], weights, 0.0) for k in range(er.FOLDS)]
    plain, garbled = [], []
    for w, folds in words:
        made = er.garbled_forms(w)
        for k, n in enumerate(folds):
            plain.append((n, er.choose(models[k], w)[0]))
            for text in made:
                gain, fixed, _ = er.choose(models[k], text)
                garbled.append((n / len(made), gain, fixed.lower() == w))
    for m, taken, missed, wrong in curve:
        assert taken == pytest.approx(sum(n for n, g in plain if g > m) / sum(n for n, _ in plain))
        assert missed == pytest.approx(sum(n for n, g, _ in garbled if g <= m) / sum(n for n, *_ in garbled))
        assert wrong == pytest.approx(sum(n for n, g, right in garbled if g > m and not right) / sum(n for n, *_ in garbled))


def test_lost_last_letters_do_not_depend_on_the_margin_of_chains():
    import numpy as np

    counts = np.zeros(er.BUCKETS)
    t = "\x02café\x03"
    for k in (1, 2, 3):
        for j in range(len(t) - k + 1):
            counts[er.gram_bucket(t[j : j + k])] += 1000
    for margin in (0.0, 20.0):
        model = er.Model(counts, 1000.0 * len(t), er.Model.WEIGHTS, margin)
        assert er._lost_letters(model, "caf?") and not er._lost_letters(model, "ready?")


def test_the_curve_decides_on_stuffed_sentences():
    judge = spam.Judge({"en": {"the": 0.9, "was": 0.6, "of": 0.8, "in": 0.7, "we": 0.6}})
    page = " ".join(f"We offer free hive parser in {x}." for x in ("Lumen", "Hills", "Vale", "Hollow", "Field", "Moor") * 4)
    assert judge.spam_part(page, True) > spam.GREATER_PART and judge.spam_part(page, False) == 0.0


def test_repetitive_prose_is_no_spam(spark):
    random.seed(12)
    good = [" ".join(PROSE.format(*random.sample(NOUNS, 2)) for _ in range(random.randint(2, 6))) for _ in range(150)]
    good += [" ".join(f"The hive {random.choice(['keeps', 'shows', 'loses'])} {random.choice(['every record', 'no value', 'the first entry'])} {random.choice(['after the copy', 'before the review', 'for the report'])}." for _ in range(8)) for _ in range(5)]
    bad = [" ".join(f"We offer free hive parser in {random.choice(['Lumen', 'Northvale', 'Hollow', 'Tarn'])} {random.choice(['Hills', 'East', 'Central'])}." for _ in range(40)) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    assert sorted(r[0] for r in spam.spam_pages(df).collect()) == [155, 156, 157]
