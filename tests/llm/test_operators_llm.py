"""The text operators against brute force, round trips and held-out cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomlex.llm import language, mixture, mojibake, names, packing, reflink, scans, spam, termcount, tokens
from loomlex.session import stage_table

RU = "Региональный рынок определяет границы социальной политики. Следует отметить, что бюджетный процесс опирается на анализ занятости."
EN = "The regional market sets the limits of the social policy. It should be noted that the budgetary process is based on the analysis of employment."
DE = "Die regionale Wirtschaft bestimmt die Grenzen der sozialen Politik. Wie die Praxis zeigt, beruht die Planung auf der Beschäftigung."
FR = "Le marché régional détermine les limites de la politique sociale. Il faut noter que la planification dépend de la consommation publique."
UK = "Регіональний ринок визначає межі соціальної політики. Слід зазначити, що бюджетний процес спирається на аналіз зайнятості."


# ---------------------------------------------------------------- terms


def brute_terms(rows):
    occ, rec = Counter(), defaultdict(set)
    for article, text in rows:
        for t in re.findall(r"[^\W\d_]+", text or ""):
            occ[t.lower()] += 1
            if article is not None:
                rec[t.lower()].add(article)
    return {t: (n, len(rec[t])) for t, n in occ.items()}


def test_signed_deltas_equal_a_recount(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: rng.choice(["Рынок", "рынок", "спрос", "a1b", "x", "труд", "don't", ""])
    old = [(i, rng.choice([1, 2, 3, 4, None]), " ".join(word() for _ in range(12)) if i % 5 else None) for i in range(40)]
    new = [r for r in old if r[0] % 7] + [(100 + i, 2, "новый рынок") for i in range(3)]
    new = [(i, a, (t or "") + " изменено" if i % 11 == 0 else t) for i, a, t in new]
    schema = "row long, article_id long, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    got = lambda df: {r["term"]: (r["occurrences"], r["records"]) for r in df.collect() if r["term"]}
    store = termcount.TermStore(spark, str(tmp_path / "counts"), 8)
    assert store.read().count() == 0 and store.records() == 0
    assert store.apply("load", termcount.text_delta(termcount.signed_changes(None, frame(old), "row", "text")))
    assert got(store.read()) == brute_terms([r[1:] for r in old]) and store.records() == 4
    delta = termcount.text_delta(termcount.signed_changes(frame(old), frame(new), "row", "text"))
    want = brute_terms([r[1:] for r in new])
    assert store.apply("second", delta) and got(store.read()) == want
    assert not store.apply("second", delta) and got(store.read()) == want  # a change that comes again changes nothing
    assert not termcount.TermStore(spark, str(tmp_path / "counts"), 8).apply("load", delta)
    gone = termcount.text_delta(termcount.signed_changes(frame(new), frame([]), "row", "text"))
    assert store.apply("all gone", gone) and store.read().count() == 0 and store.state()["buckets"] == {}


def test_a_merge_that_fails_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    delta = lambda n: spark.createDataFrame([("a", n, 1), ("b", 1, 1)], "term string, d_occurrences long, d_records long")
    store = termcount.TermStore(spark, str(tmp_path / "counts"), 2)
    store.apply("one", delta(3))
    with monkeypatch.context() as m:
        m.setattr(termcount.TermStore, "_commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.apply("two", delta(4))
    assert {(r[0], r[1]) for r in store.read().collect()} == {("a", 3), ("b", 1)}
    assert store.apply("two", delta(4)) and {(r[0], r[1]) for r in store.read().collect()} == {("a", 7), ("b", 2)}


def test_added_rows_count_a_record_once(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), " ".join(rng.choice("абвгде") for _ in range(6)) if i % 4 else None) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "article_id long, text string")
    store = termcount.TermStore(spark, str(tmp_path / "counts"), 4)
    store.apply("load", termcount.text_delta(termcount.signed_changes(None, frame(rows[:30]), "", "text")))
    store.apply("late", termcount.text_delta(termcount.added_changes(frame(rows[:30]), frame(rows[30:]), "text")))
    assert {r["term"]: (r["occurrences"], r["records"]) for r in store.read().collect() if r["term"]} == brute_terms(rows) and store.records() == 5


def test_keyword_delta(spark):
    rows = spark.createDataFrame([(1, 1, [" A  b", "a b", None, " "]), (1, 1, ["A b"]), (2, 1, None), (None, 1, ["z"])], "article_id long, sign int, terms array<string>")
    got = {r["term"]: (r["d_occurrences"], r["d_records"]) for r in termcount.list_delta(rows).collect()}
    assert got == {"a b": (3, 1), "z": (1, 0)}


# ---------------------------------------------------------------- tokens, containers, mixtures


def test_token_counter_equals_the_tokenizer():
    c = tokens.TokenCounter()
    rng = random.Random(2)
    for _ in range(300):
        s = "".join(rng.choice(["рынок", " ", "  ", "\n", "it's", "a", "12", "—", " ", ".", "é"]) for _ in range(rng.randrange(25)))
        assert c.count(s) == len(c.encode(s))
    assert c.count(None) == c.count("") == 0


def test_containers(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 1, 5, 40, 99, 100, 101, 350])) for i in range(3000)] + [(7, 60), (None, 3)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    rows = packing.pack(df, [("c", 100)], lane=800, open_most=32).collect()
    held = Counter()
    for r in rows:
        if r["n_tokens"] == 0:
            assert r["container_id"] is None
            continue
        held[r["container_id"]] += r["piece_tokens"]
        assert r["n_tokens"] > 100 or r["piece_tokens"] == r["n_tokens"]
    assert max(held.values()) <= 100 and sum(held.values()) == sum(n for _, n in sizes)
    assert sum(held.values()) / (100 * len(held)) > 0.95
    assert packing.pack(df.limit(0), [("c", 100)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [("c", 0)])


def test_best_fit_takes_the_fullest_that_fits():
    b = packing.Bins(10, 2)
    assert [b.put(6), b.put(7), b.put(3), b.put(4)] == [0, 1, 1, 0]
    assert b.put(9) == 2 and b.put(8) == 3 and b.put(5) == 4 and b.put(2) == 3  # the fullest of two open ones was closed


def test_pfair_stays_within_a_block_of_the_target():
    many = {str(i): 0.9 / 4999 for i in range(4999)} | {"thin": 0.1}
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"x": 1.0}, {str(i): 1 + i for i in range(13)}, {"a": 0.9999, "b": 0.0001}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, many):
        parts = mixture.whole_weights(weights)
        q, total = sum(parts.values()), sum(weights.values())
        done = Counter()
        watched = sorted(weights, key=weights.get)[:3] + sorted(weights, key=weights.get)[-3:]
        for t, s, k, release, due in mixture.pfair(parts, 60_000):
            done[s] += 1
            assert release <= t < due and k == done[s] - 1
            assert all(abs(done[x] - (t + 1) * weights[x] / total) < 1 for x in watched)
        if q <= 60_000:
            assert done == Counter(parts)


def test_weights_of_any_number_of_sources():
    rng = random.Random(3)
    equal = mixture.whole_weights({str(i): 1.0 for i in range(5000)})
    assert set(equal.values()) == {1} and len(equal) == 5000
    assert mixture.whole_weights({"a": 0.9999, "b": 0.0001}) == {"a": 9999, "b": 1}
    odd = mixture.whole_weights({str(i): rng.random() for i in range(5000)})
    assert sum(odd.values()) <= mixture.PERIOD and min(odd.values()) >= 1
    tiny = mixture.whole_weights({str(i): 1e-12 for i in range(5000)} | {"big": 1.0})
    assert tiny["big"] == mixture.PERIOD - 5000 and set(tiny.values()) == {1, tiny["big"]}
    with pytest.raises(ValueError):
        mixture.whole_weights({"a": 1.0, "b": 1.0, "c": 1.0}, 2)


def test_every_use_has_its_slot(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, " ".join("рынок" for _ in range(rng.randrange(1, 400))), "abc"[min(i % 20, 2)]) for i in range(400)] + [(900, "x y", "other"), (901, None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 0.2, 9), ("b", 0.1, 2), ("c", 0.7, 1), ("none", 0.5, 3)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mixture_target.parquet"))
    rows = mixture.p8_mixture(spark, str(tmp_path)).collect()
    uses = Counter(r["doc_id"] for r in rows if r["repeats"])
    assert all(uses[r["doc_id"]] == r["repeats"] for r in rows if r["repeats"]) and max(uses.values()) > 1
    assert {r["doc_id"] for r in rows if not r["repeats"]} >= {900, 901} and all(r["slot"] is None for r in rows if not r["repeats"])
    total = sum(r["n_tokens"] for r in rows if r["repeats"])
    ordered = sorted((r for r in rows if r["repeats"]), key=lambda r: (r["slot"], r["place"]))
    for s, w in (("a", 0.2), ("b", 0.1), ("c", 0.7)):
        own = [r for r in ordered if r["source"] == s]
        assert [r["place"] for r in own] == sorted(r["place"] for r in own) and len({r["place"] for r in own}) == len(own)
        assert abs(sum(r["n_tokens"] for r in own) / total - w) < 0.01
    slots = {(r["source"], r["block"]): r["slot"] for r in ordered}
    assert len(set(slots.values())) == len(slots)  # no two blocks share a slot
    for s, w in (("a", 0.2), ("b", 0.1), ("c", 0.7)):
        assert all(abs(slots[s, k] - k / w) <= 1 / w + 1 for x, k in slots if x == s)


def test_amounts_reach_the_targets():
    got = mixture.amounts({"a": 1000, "b": 10, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 4, "c": 9})
    assert got == {"a": 67, "b": 40} and mixture.amounts({}, {"a": 1.0}, {"a": 1}) == {}


# ---------------------------------------------------------------- wrong encodings


@pytest.mark.parametrize("chain", range(len(mojibake.CHAINS)))
def test_chains_are_undone(chain):
    tried = 0
    for s in ("рынок", "é", "für", "Поиск", "ё"):
        try:
            bad = mojibake.damage(chain, s)
        except (UnicodeEncodeError, KeyError):
            continue
        tried += 1
        assert mojibake.undo(chain, bad) == s
    assert tried


def model_of(spark, texts):
    values = spark.createDataFrame([("f", i, "s", t) for i, t in enumerate(texts)], "field_name string, record_id long, source string, value string")
    return mojibake.fit_model(mojibake.token_counts(values))


def test_recurring_damage_never_makes_a_clean_word_suspect(spark):
    clean = "Решение принято в рамках целевой программы (англ. target programme)."
    bad = [d for c in range(len(mojibake.CHAINS)) for w in ("рамках", "программы") if (d := encoded(c, w)) and d != w and mojibake.usual(d)]
    assert bad
    model = model_of(spark, [clean] * 200 + [f"Решение принято в {d} целевой программы" for d in bad for _ in range(20)] + ["РСФСР и КПЭ-2 об-"] * 20)
    assert {"рамках", "англ", "рсфср"} <= model.words and not {d.lower() for d in bad} & model.words
    fix = mojibake.Repairer(model, mojibake.Shares())
    assert not any(fix.repair(t, "g|")[0] for t in (clean, "(КПЭ-2). РСФСР: в рамках", "об-", "эх, ну и НА том"))
    assert fix.repair(mojibake.damage(0, "программы" * 60), "g|") == (True, "программы" * 60)  # a token of 1080 characters


def test_words_past_those_in_memory_are_known(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "LEXICON", 3)
    monkeypatch.setattr(mojibake, "TYPES", 3, raising=False)
    texts = ["это было так и не иначе"] * 50 + ["региональный рынок", "бюджетный процесс", "ёжъ ыцщ"] * 4
    few = model_of(spark, texts)
    monkeypatch.setattr(mojibake, "LEXICON", 60_000)
    monkeypatch.setattr(mojibake, "TYPES", 40_000, raising=False)
    full = model_of(spark, texts)
    assert {"региональный", "рынок", "бюджетный", "ыцщ", "было"} <= few.words and set(few.words) == set(full.words) and "неизвестно" not in few.words
    assert few.three == full.three and few.log("процесс") == full.log("процесс")
    tokens = [t for c in (0, 9, 15) for w in ("рынок", "процесс", "ёжъ", "ыцщ") if (t := encoded(c, w))] + ["ыцщ", "ёжъ"]
    held = spark.sparkContext.broadcast(few)
    far = dict(spark.sparkContext.parallelize(tokens, 2).map(lambda t: (t, mojibake.Explainer(held.value)[t])).collect())  # in the workers
    assert far == {t: mojibake.Explainer(full)[t] for t in tokens} and any(far.values())


def encoded(chain, text):
    try:
        return mojibake.damage(chain, text)
    except (UnicodeEncodeError, KeyError):
        return None


def test_groups_past_the_largest_pool_their_evidence(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "GROUPS", 2)
    texts = [("f", i, f"s{i % 7}", RU if i % 2 else mojibake.damage(0, RU)) for i in range(140)]
    values = spark.createDataFrame(texts, "field_name string, record_id long, source string, value string")
    counts = mojibake.token_counts(values)
    shares = mojibake.em_shares(counts, mojibake.fit_model(counts))
    assert len(shares.by_group) == 3 and shares.of("f|s6") == shares.by_group["f|"] and shares.of("f|s6")[1] > -2


def test_repair(spark):
    texts = [RU, EN, DE, FR, UK, "Поиск по лемме: новый рынок"] * 30
    fix = mojibake.Repairer(model_of(spark, texts), mojibake.Shares())
    for chain in (0, 1, 5, 9, 10, 15):
        bad = mojibake.damage(chain, "Региональный рынок определяет границы")
        assert fix.repair(bad, "g|") == (True, "Региональный рынок определяет границы")
    part = "Следует отметить, что " + mojibake.damage(0, "бюджетный процесс") + " опирается"
    assert fix.repair(part, "g|") == (True, "Следует отметить, что бюджетный процесс опирается")
    for good in (RU, DE, FR, UK, "Вопрос??? повторить", "Â-система и Ê-модель", "Ñuvel Ðarko", "a?b=1&c=2 http://x/?q=1", "", None):
        assert fix.repair(good, "g|")[0] is False
    for lost in ("???? ???????: рынок", "Donn?es", "can�t be", "Export ? the market"):
        assert fix.repair(lost, "g|") == (True, lost)


# ---------------------------------------------------------------- languages


def test_languages_of_sentences():
    rows = [(t, k) for t, k in ((RU, "ru"), (EN, "en"), (DE, "de"), (FR, "fr"), (UK, "uk")) for _ in range(20)] + [(RU, "en")] * 3
    s = language.Scorer(*language.fit(rows))
    of = lambda t: [language.LANGUAGES[x[2]] for x in language.segments(s, language.join_lines(t))]
    assert of(RU) == ["ru"] and of(UK) == ["uk"] and of(f"{RU} {EN}") == ["ru", "en"] and of(f"{DE}\n\n{FR} {RU}") == ["de", "fr", "ru"]
    assert of("Социальный рынок зависит от поли-\nтики региона и бюджета.") == ["ru"]
    assert of(mojibake.damage(0, "Региональный рынок определяет границы социальной политики.")) == ["ru"]
    assert of("") == [] and of("12 34 ...") == [] and of("???? ?????? ???? ????.") == []


def test_a_body_of_three_languages_and_confidence(spark, tmp_path):
    rows = [(t, k) for t, k in ((RU, "ru"), (EN, "en"), (DE, "de"), (FR, "fr"), (UK, "uk")) for _ in range(20)]
    texts = [(i, i, "", "", "", t, None, None) for i, (t, _) in enumerate(rows)] + [(500, 500, "", "", "", f"{RU} {EN} {DE}", None, None)]
    spark.createDataFrame(texts, "text_id long, article_id long, title_text string, abstract_text string, keywords_text string, body_text string, created_at timestamp, updated_at timestamp").write.parquet(str(tmp_path / "article_text.parquet"))
    labels = [(i, k) for i, (_, k) in enumerate(rows)] + [(500, "ru-en")]
    spark.createDataFrame(labels, "article_id long, language string").write.parquet(str(tmp_path / "article_metadata.parquet"))
    assert sorted(r["lang"] for r in language.p1_found(spark, str(tmp_path)).collect()) == ["de", "en", "ru"]
    s = language.Scorer(*language.fit(rows))
    truth = [(t, language.LANGUAGES.index(k)) for t, k in rows]
    best, at_one, at_best = language.calibrate(s, truth)
    assert best in language.TEMPERATURES and at_best <= at_one
    s.temperature = 40.0
    whole = language.segments(s, f"{RU} {EN}")
    assert [language.LANGUAGES[x[2]] for x in whole] == ["ru", "en"] and all(0.2 <= x[3] < 1 for x in whole)


def test_garbled_words_never_become_known():
    bad = mojibake.damage(9, RU)
    words, _, _ = language.fit([(t, k) for t, k in ((RU, "ru"), (EN, "en"), (DE, "de"), (FR, "fr"), (UK, "uk"), (bad, "de")) for _ in range(10)])
    assert "рынок" in words and "beschäftigung" in words and not set(bad.lower().split()) & set(words)


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (" RU", "en-ru", "ru-en", "русский", "ru-ru", "ru-en-de", "", None, "-")], "l string")
    assert [r[0] for r in df.select(language.label_of(F.col("l"))).collect()] == ["ru", "en-ru", "en-ru", None, None, None, None, None, None]


def test_mild_damage_is_tried_against_every_chain():
    class Model:
        words = frozenset({"für", "beschäftigung", "marché"})

        def log(self, token):
            return (-1.5 if token.lower() in self.words else -2.8) * (len(token) + 1)

    explain = mojibake.Explainer(Model())
    chain = mojibake.CHAINS.index((("cp1251", "cp1252"),))
    for w in ("für", "Beschäftigung", "marché"):
        assert (chain, w) in [(c, fixed) for _, c, fixed in explain[mojibake.damage(chain, w)]]


# ---------------------------------------------------------------- names


def test_readings_agree():
    g = frozenset(map(names.code, ("Иван", "Инна", "Ирина", "Robert", "Andrew")))
    read = lambda *x: names.read(*x, g)
    base = read("Петренко", "Иван", "Юрьевич")
    same = [("Петренко Иван Юрьевич", "", ""), ("Иван", "Петренко", "Юрьевич"), ("Petrenko", "Ivan", "Jur'evich"), ("Пeтpeнкo", "Ваня", None), ("И. Ю. ПЕТРЕНКО", None, None), ("Петернко", "Иван", "Юрьевич"), ("Петренко", "И.Ю.", "")]
    assert all(names.agree(base, read(*x), g) for x in same)
    other = [("Петренко", "Инна", "Юрьевна"), ("Петренко", "Пётр", "Юрьевич"), ("Петриков", "Иван", "Юрьевич"), ("Петренко", "И.", "А.")]
    assert not any(names.agree(base, read(*x), g) for x in other)
    assert not names.agree(read("Петрова", "И.", ""), read("Петров", "Иван", ""), g)
    assert read(None, None, None) == ("", "", "") and read(" . ", "", "")[0] == ""


def test_misspelt_given_names_are_no_names_of_their_own(spark):
    rng = random.Random(4)
    surnames = ["".join(rng.choice("бвгдклмнрст") + rng.choice("аеиоу") for _ in range(5)) + "н" for _ in range(90)]
    rows = [(s, first, "") for first, n in (("Марина", 90), ("Алла", 70), ("Элла", 60), ("Морина", 6), ("Мрина", 4), ("Аллла", 5)) for s in rng.sample(surnames, n)]
    rows += [("Петренко", "Марина", "Юрьевна"), ("Петренко", "Морина", "Юрьевна"), ("Громова", "Алла", "Юрьевна"), ("Громова", "Элла", "Юрьевна")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "author_id long, last_name string, first_name string, middle_name string")
    assert names.given_lexicon(df) == frozenset(map(names.code, ("Марина", "Алла", "Элла")))
    of = {r["author_id"]: r["person"] for r in names.persons(df).where(F.col("author_id") >= len(rows) - 4).collect()}
    marina, morina, alla, ella = (of[len(rows) - i] for i in (4, 3, 2, 1))
    assert marina == morina and alla != ella


def test_segment_join_misses_no_pair(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("абвгд") for _ in range(rng.randrange(2, 11))) for _ in range(300)}
    for w in sorted(words)[::3]:
        i, j = rng.randrange(len(w)), rng.randrange(len(w))
        words |= {w[:i] + "е" + w[i:], (w[:j] + w[j + 1 :])[:i] + "е" + (w[:j] + w[j + 1 :])[i:]}
    words.discard("")
    rows = [(w, "и", "п") for w in words] + [("", "и", "п"), ("абвгдеж", "", "п"), ("абвгдежз", "и", names.NONE)]
    df = spark.createDataFrame(rows, "surname string, initial string, second string")
    got = {(r["a"], r["b"]) for r in names.surname_pairs(df).where("a <> 'абвгдежз' and b <> 'абвгдежз'").collect()}
    long = sorted(w for w in words if len(w) > 2)
    want = {(a, b) for i, a in enumerate(long) for b in long[i + 1 :] if names.close(a, b)}
    assert got == want and any(names.edits(a, b, 2) == 2 and not names.near(a, b) for a, b in want)


def test_hard_spellings_meet(spark):
    rows = [
        ("Лис", "Анна", "Петровна"), ("Лиз", "Анна", "Петровна"), ("Лис", "Алла", "Петровна"),  # short surnames with one edit
        ("Месифаков", "Богдан", "Эдуардович"), ("Месифакооов", "Богдан", "Эдуардович"), ("Месифаков", "Б.", "Э."),  # two edits
        ("Стадедов", "Николай", "Дмитриевич"), ("Стадедов", "Нигалай", "Дмитриевич"), ("Стадедов", "Н", "Д"),
        ("Kladahakev", "Pjotr", "Dmitrievich"), ("Кладахакев", "Пётр", "Дмитриевич"),
        ("Дегинская", "Ксения", "Дмитриевна"), ("Дегинская", "Ксюша", "Дмитриевна"), ("Дегинская", "Оксана", "Дмитриевна"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "author_id long, last_name string, first_name string, middle_name string")
    of = {r["author_id"]: r["person"] for r in names.persons(df).collect()}
    assert of[0] == of[1] != of[2]
    assert of[3] == of[4] == of[5] and of[6] == of[7] == of[8] and of[9] == of[10]
    assert of[11] == of[12]


def test_components(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(20)]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = names.components(spark.createDataFrame([(n,) for n in nodes], "form string"), spark.createDataFrame(edges, "a string, b string"))
    assert {r["form"]: r["person"] for r in got.collect()} == {n: root(n) for n in nodes}


# ---------------------------------------------------------------- reference lists


def test_pigeonhole_join_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("абв") for _ in range(n))
    forms = sorted({word(rng.randrange(8, 12)) for _ in range(40)})
    runs = sorted({word(rng.randrange(7, 13)) for _ in range(60)} | {f[:3] + "г" + f[4:] for f in forms} | {f[:-1] for f in forms} | {f[1:] + "г" for f in forms})
    f = stage_table(spark.createDataFrame([(i, None, "city", w, 2) for i, w in enumerate(forms)], "ref_id long, city_id long, kind string, form string, k int"))
    r = stage_table(spark.createDataFrame([(i, "city", w) for i, w in enumerate(runs)], "id long, kind string, q string"))
    got = {(x["id"], x["ref_id"], x["dist"]) for x in spark.sql(reflink.FUZZY, runs=reflink._shifted(spark, r), forms=f).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(i, j, d) for i, q in enumerate(runs) for j, w in enumerate(forms) if (d := lev(q, w)) < 2 or d == 2 and sorted(q) == sorted(w)}
    assert got == want and len(want) > 40


# ---------------------------------------------------------------- scans


PARA = "региональный рынок определяет границы социальной политики и занятости населения страны"


def editor_of(spark):
    lexicon = dict.fromkeys(PARA.split(), 50) | {"отдельных": 9, "условиях": 9, "производство": 9, "экономике": 5, "потребность": 5, "конкуренция": 5}
    scanned = Counter({w: 3 for w in lexicon}) + Counter({w.replace("о", "0", 1): 4 for w in lexicon if "о" in w and len(w) > 4})
    rows = [("word", w, n) for w, n in lexicon.items()] + [("scan", w, n) for w, n in scanned.items()]
    confusions, pairs = scans.confusions_of(spark.createDataFrame(rows, "kind string, word string, n long"))
    assert set(confusions) == {("0", "о")} and ("рын0к", "рынок") in pairs
    ends = [("социа", "льной", "л", "-"), ("рын", "ок", "о", "-"), ("политики", "занятости", "з", "-"), ("рынок", "страны", "С", "-")] * 10
    return scans.build_editor(lexicon, confusions, pairs, [w for w in scanned if w in lexicon], ends)


def test_scanned_page(spark):
    editor = editor_of(spark)
    assert editor.edit("рын0к") == ("рынок", 3) and editor.edit("рынок")[1] == -1 and editor.edit("п0лит0лог") == ("политолог", 1)
    lines = ["ЖУРНАЛ ЭКОНОМИКИ", "региональный рын0к определяет границы социа-", "льной политики и занятости населения страны,", "- 12 -", "ЖУРНАЛ ЭКОНОМИКИ", "и региональный рынок определяет границы соци-", "альной политики и занятости населения страны.", "- 13 -"]
    heads = frozenset({"журналэкономики"})
    for judge in (scans.SEED, scans.fit_furniture([("\n".join(lines), "", heads)] * 60)):
        rows = scans.body_lines("\n".join(lines), "", editor, judge, heads)
        assert (2, "chars") in rows and (2, "hyphen") in rows and (6, "hyphen") in rows
        assert {n for n, k in rows if k == "page_number"} == {4, 8} and {n for n, k in rows if k == "header"} == {1, 5}
        text = scans.clean_text("\n".join(lines), "", editor, judge, heads)
        assert "рынок определяет границы социальной политики" in text and "ЖУРНАЛ" not in text and "12" not in text
    assert scans.body_lines("", "", editor) == [] and scans.body_lines("a\nb\nc", "", editor) == []
    assert scans.clean_text("Обычный текст.", "", editor) is None
    assert editor.edit("щ" * 5000) == ("щ" * 5000, -1) and editor.edit("рын0к" * 900)[1] == 3


def test_misreadings_that_recur_in_unscanned_bodies_stay_misreadings(spark):
    good = [*PARA.split(), "отдельных", "условиях", "производство", "экономике", "потребность", "конкуренция"]
    bad = [w.replace("о", "0", 1) for w in good if "о" in w and len(w) > 4]
    rows = [("word", w, 4000) for w in good] + [("scan", w, 1000) for w in good] + [("word", "стидашов", 2), ("scan", "стидашов", 1)]
    rows += [("word", w, 50) for w in bad] + [("scan", w, 700) for w in bad] + [("word", "вестник", 7), ("scan", "вестник", 260)]
    words = spark.createDataFrame(rows, "kind string, word string, n long")
    confusions, pairs = scans.confusions_of(words)
    assert set(confusions) == {("0", "о")} and {w for w, _ in pairs} == set(bad)
    known = [tuple(r) for r in scans.known_words(words).collect()]
    assert {w for w, _, doubt in known if doubt} == {*bad, "вестник"}
    assert set(scans.lexicon_of(known, confusions)) == {*good, "стидашов", "вестник"}


def test_line_ends_are_predicted(spark):
    editor = editor_of(spark)
    of = lambda line, after: editor.line_end(line, after)[0]
    assert of("границы социа-", "льной политики") == of("границы мунипа-", "литета и") == "join"
    assert of("социальной политики-", "занятости страны") == "hyphen" and of("границы рынка-", "Региона страны") == "break"
    assert of("границы рынка", "региона") == of("границы -", "региона") == of("границы", "") == "break"


def test_operations_make_the_word():
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choice("абвrn") for _ in range(rng.randrange(1, 9)))
        i = rng.randrange(len(w))
        seen, meant = w[i : i + rng.randrange(0, 3)], "".join(rng.choice("абm") for _ in range(rng.randrange(0, 3)))
        ops = scans.operations(i, seen, meant)
        assert scans.perform(w, ops) == w[:i] + meant + w[i + len(seen) :]
        assert {o for o, _, _ in ops} <= {"replace", "delete", "insert"}


def test_confusion_join_equals_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("абвг") for _ in range(rng.randrange(5, 9)))
    known, seen = sorted({word() for _ in range(60)}), sorted({word().replace("а", rng.choice("а0"), 1) for _ in range(80)})
    seen = [w for w in seen if w not in known]

    def reached(w):
        out = {}
        for m in known:
            pairs = [(x, y) for r, x in scans.holes(w) for q, y in scans.holes(m) if r == q and scans.confusable(x, y)]
            if pairs:
                out[m] = min(pairs, key=lambda p: (len(p[0]) + len(p[1]), p))
        return out

    want = {w: (m, *c) for w in seen if len(r := reached(w)) == 1 for m, c in r.items()}
    rows = [("word", w, 5) for w in known] + [("scan", w, 1) for w in seen]
    counts = Counter((a, b) for _, a, b in want.values())
    got, pairs = scans.confusions_of(spark.createDataFrame(rows, "kind string, word string, n long"))
    assert all(n == counts[c] for c, n in got.items()) and all(want[w][0] == m for w, m in pairs)


def test_header_keys_equal_all_pairs(spark):
    rng = random.Random(8)
    heads = ["".join(rng.choice("абвгде") for _ in range(rng.randrange(5, 22))) for _ in range(400)]  # past any former limit
    rows = [(t, h, 1) for i, h in enumerate(heads) for t in range(5 * i, 5 * i + 4)]
    odd = []
    for i, h in enumerate(heads):
        x = list(h)
        for _ in range(rng.randrange(1, 4)):
            j = rng.randrange(len(x))
            x[j : j + 1] = rng.choice(("", "ж", "жз"))
        odd.append("".join(x))
    rows += [(100_000 + i, k, 0) for i, k in enumerate(odd)] + [(200_000 + i, "введение", int(i < 5)) for i in range(40)]
    got = {(r["text_id"], k) for r in scans.header_keys(spark.createDataFrame(rows, "text_id long, key string, heads int")).collect() for k in r["headers"]}
    exact = set(heads)
    want = {(t, k) for t, k, _ in rows if k in exact or len(k) > 11 and any(len(h) > 9 and scans.near(h, k, 2) for h in exact)}
    assert got == want and len({k for t, k in want if t >= 100_000}) > 50


def page(head, foot="- 12 -"):
    return ["региональный рынок определяет границы социаль-", "ной политики и занятости населения страны, а", foot, head, "также региональный рынок определяет границы со-", "циальной политики и занятости населения."]


def test_marks_in_headers_are_penalties_only():
    kind = lambda head, title="", headers=frozenset(): scans.classify(page(head), title, headers)[1][3]
    assert kind("КЛАРИЧИНИН Ю. А.") == kind("VLOBIBULUK A.") == kind("ИВАНОВ А. Б., СИДОРОВА В.") == scans.HEADER
    title = "2. Региональный рынок и границы"
    assert kind(title, title) == kind("региональный рынок и границы", title[3:]) == kind("Региональный рынок и границы.", title[3:]) == scans.HEADER
    assert kind("Вестник | ISSN 1234-5678") == scans.HEADER
    assert scans.HEADER not in map(kind, ("занятость населения", "1) занятость населения", "Это сказал Иванов И. И."))
    broken = ["региональный рынок определяет границы социаль-", "ной политики и занятости населения страны, а", "КЛАРИЧИНИН Ю. А.", "также региональный рынок определяет границы со-", "циальной политики и занятости населения."]
    assert scans.classify(broken, "")[1][2] == scans.HEADER
    ended = [*broken[:1], "ной политики и занятости населения страны.", "- 12 -", "КЛАРИЧИНИН Ю. А.", "Также региональный рынок определяет границы со-", broken[-1]]
    assert scans.classify(ended, "")[1][3] == scans.HEADER


def test_survey_counts_headers_with_end_marks(spark):
    rows = [(i, "", "\n".join(page("Вестник экономики."))) for i in range(5)]
    _, lines, sample = scans.survey(spark.createDataFrame(rows, "text_id long, title_text string, body string"))
    headers = {r["text_id"]: frozenset(r["headers"]) for r in scans.header_keys(lines).collect()}
    assert sample.count() == 5 and set(headers) == set(range(5)) and all("вестникэкономики" in h for h in headers.values())
    assert scans.classify(page("Вестник экономики."), "", headers[0])[1][3] == scans.HEADER


# ---------------------------------------------------------------- spam


def test_spam_and_prose():
    rng = random.Random(11)
    goods = ["диван", "реферат", "септик", "патент", "сейф", "плитка"]
    prose = lambda: " ".join(rng.sample([RU, EN, DE, FR, UK], 3))
    links = lambda: "\n".join(f"[купить {rng.choice(goods)}](https://a.example/p/{rng.randrange(99)})" for _ in range(12))
    tags = lambda: " ".join(f"#купить_{rng.choice(goods)}" for _ in range(30))
    menu = lambda: "\n".join(f"купить {rng.choice(goods)} цена" for _ in range(20))
    books = lambda: "\n".join(f"{i}. Петров П. Рынок и политика // Журнал. 20{10 + i}. № 1. С. 5." for i in range(1, 9))
    phrases = lambda: " ".join(f"{rng.choice(['рыночная агломерация', 'городской транспорт', 'кредитный аудит'])}{rng.choice(['', '.', ','])}" for _ in range(60))
    short = lambda: rng.choice(["Нет текста", "Анализ занятости.", "Статья снята", "Рынок и политика"])
    kinds = (prose, prose, prose, links, tags, menu, books, phrases, short)
    model = spam.train([k() for k in kinds for _ in range(40)])
    bare = spam.Words()
    share = lambda t: spam.spam_share(*spam.label(model, t, bare))
    assert max(share(prose()) for _ in range(20)) < 0.5 < min(share(k()) for k in (links, tags, menu, phrases) for _ in range(10))
    assert share("Анализ занятости.") < 0.5 < share("\n".join(["[диван](https://a.example/p/1)"] * 2))  # short texts are labelled like any other
    assert share(books()) < 0.5 and share(prose() + "\n\n" + links().split("\n")[0]) < 0.5
    assert share(None) == share("") == share(" \n ") == share(".") == 0.0
