"""Stems and stop words of the two text-search configurations, as SQL that Spark and DuckDB both run.

The stemmers are the public Snowball algorithms for Russian and English, written as suffix rules on a
word and the places where its regions begin.  Each step is a ``CASE`` over regular expressions; steps
are bound to names by one-element arrays, so that no expression is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the two configurations.
ENGLISH_STOPS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
RUSSIAN_STOPS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был "
    "него до вас нибудь опять уж вам сказал ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под жизнь будет "
    "ж тогда кто этот говорил того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется сейчас были куда зачем сказать всех никогда сегодня можно при наконец два об "
    "другой хоть после над больше тот через эти нас про всего них какая много разве сказала три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда "
    "конечно всю между"
).split()

#: Russian endings by class; those of a first group stand after а or я.
GERUND = ("в|вши|вшись", "ив|ивши|ившись|ыв|ывши|ывшись")
ADJECTIVE = "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE = ("ем|нн|вш|ющ|щ", "ивш|ывш|ующ")
VERB = ("ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно", "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю")
NOUN = "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"
#: English words with stems of their own, and words that stay as they are.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = "sky|news|howe|atlas|cosmos|bias|andes"
AFTER_PLURAL = "inning|outing|canning|herring|earring|proceed|exceed|succeed"
#: English suffixes with what replaces them, longest first: second and third step.
STEP_2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"),
    ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


class Dialect:
    """How an engine writes bindings and regular expressions."""

    def __init__(self, name: str) -> None:
        self.spark = name == "spark"
        self.count = 0

    def bind(self, value: str, body: Callable[[str], str]) -> str:
        """``body`` of a name that stands for ``value``."""
        self.count += 1
        name = f"x{self.count}"
        return f"transform(array({value}), {name} -> {body(name)})[0]" if self.spark else f"list_transform([{value}], lambda {name}: {body(name)})[1]"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} rlike '{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def swap(self, x: str, pattern: str, new: str) -> str:
        """First match replaced; ``new`` may hold <1> for the first group."""
        return f"regexp_replace({x}, '{pattern}', '{new.replace('<1>', '$1' if self.spark else chr(92) * (2 if self.spark else 1) + '1')}')"

    def after(self, x: str, pattern: str) -> str:
        """The first group, '' without a match."""
        return f"regexp_extract({x}, '{pattern}', 1)"


def cases(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def russian(word: str, d: Dialect) -> str:
    """Stem of a word in small letters."""
    ends = lambda p: f"(?:{p})$"
    group = lambda p: f"([ая])(?:{p})$"

    def body(w: str) -> str:
        def region(rv: str) -> str:
            def rest(x: str) -> str:
                adjective = d.bind(d.swap(x, ends(ADJECTIVE), ""), lambda y: cases([(d.has(y, ends(PARTICIPLE[1])), d.swap(y, ends(PARTICIPLE[1]), ""))], d.swap(y, group(PARTICIPLE[0]), "<1>")))
                return cases([(d.has(x, ends(ADJECTIVE)), adjective), (d.has(x, ends(VERB[1])), d.swap(x, ends(VERB[1]), "")), (d.has(x, group(VERB[0])), d.swap(x, group(VERB[0]), "<1>"))], d.swap(x, ends(NOUN), ""))

            first = cases(
                [(d.has(rv, ends(GERUND[1])), d.swap(rv, ends(GERUND[1]), "")), (d.has(rv, group(GERUND[0])), d.swap(rv, group(GERUND[0]), "<1>"))],
                d.bind(d.swap(rv, "с[яь]$", ""), rest))

            def last(x: str) -> str:
                no_n = lambda y: d.swap(y, "нн$", "н")
                return cases([(d.has(x, "ейше?$"), no_n(d.swap(x, "ейше?$", ""))), (d.has(x, "нн$"), no_n(x))], d.swap(x, "ь$", ""))

            r1 = d.after(w, "^.*?[аеиоуыэюя][^аеиоуыэюя](.*)$")
            r2 = d.after(r1, "^.*?[аеиоуыэюя][^аеиоуыэюя](.*)$")

            def third(x: str) -> str:
                cut = d.after(x, "(ость?)$")
                inside = f"length({w}) - length({rv}) + length({x}) - length({cut}) >= length({w}) - length({r2})"
                return d.bind(cases([(f"{cut} <> '' AND {inside}", d.swap(x, "ость?$", ""))], x), last)

            stem = d.bind(first, lambda x: d.bind(d.swap(x, "и$", ""), third))
            return f"CASE WHEN {rv} = '' THEN {w} ELSE concat(substring({w}, 1, length({w}) - length({rv})), {stem}) END"

        return d.bind(d.after(w, "^[^аеиоуыэюя]*[аеиоуыэюя](.*)$"), region)

    return d.bind(f"replace({word}, 'ё', 'е')", body)


def english(word: str, d: Dialect) -> str:
    """Stem of a word in small letters."""
    vowel, short = "[aeiouy]", "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"

    def marked(w: str) -> str:
        """The word with the y of consonants as Y; a run of them takes two passes."""
        once = d.swap(w, "^y", "Y")
        every = (lambda x: f"regexp_replace({x}, '([aeiouy])y', '$1Y')") if d.spark else (lambda x: f"regexp_replace({x}, '([aeiouy])y', '\\1Y', 'g')")
        return every(once)

    def steps(w: str) -> str:
        rest = "^.*?[aeiouy][^aeiouy](.*)$"
        r1 = cases([(d.has(w, "^(?:gener|commun|arsen)"), d.after(w, "^(?:gener|commun|arsen)(.*)$"))], d.after(w, rest))

        def with_r1(p: str) -> str:
            def with_r2(q: str) -> str:
                inside = lambda x, suffix, start: f"length({x}) - {suffix} >= {start}"
                lead = lambda x, n: f"substring({x}, 1, length({x}) - {n})"

                def rules(x: str, table, start: str, more: list[tuple[str, str]] = ()) -> str:
                    """The longest suffix that the word has decides, whether or not it stands in the region."""
                    out = [(d.has(x, f"{a}$"), cases([(inside(x, len(a), start), f"concat({lead(x, len(a))}, '{b}')")], x)) for a, b in table]
                    return cases([*more, *out], x)

                def plural(x: str) -> str:
                    return cases([
                        (d.has(x, "sses$"), lead(x, 2)), (d.has(x, "^.ie[ds]$"), lead(x, 1)), (d.has(x, "ie[ds]$"), lead(x, 2)),
                        (d.has(x, "(?:us|ss)$"), x), (d.has(x, f"^.*{vowel}.+s$"), lead(x, 1))], x)

                def past(x: str) -> str:
                    def after_cut(y: str) -> str:
                        return cases([
                            (d.has(y, "(?:at|bl|iz)$"), f"concat({y}, 'e')"), (d.has(y, "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), lead(y, 1)),
                            (f"{d.has(y, short)} AND {p} >= length({y})", f"concat({y}, 'e')")], y)

                    cut = lambda n: cases([(d.has(lead(x, n), vowel), d.bind(lead(x, n), after_cut))], x)
                    keep = lambda n: cases([(inside(x, n, p), f"concat({lead(x, n)}, 'ee')")], x)
                    return cases([(d.has(x, "eedly$"), keep(5)), (d.has(x, "ingly$"), cut(5)), (d.has(x, "edly$"), cut(4)), (d.has(x, "eed$"), keep(3)), (d.has(x, "ing$"), cut(3)), (d.has(x, "ed$"), cut(2))], x)

                def second(x: str) -> str:
                    li = cases([(f"{inside(x, 2, p)} AND {d.has(x, '[cdeghkmnrt]li$')}", lead(x, 2))], x)
                    ogi = cases([(f"{inside(x, 3, p)} AND {d.has(x, 'logi$')}", lead(x, 1))], x)
                    table = rules(x, STEP_2, p)
                    return table[: -len(f" ELSE {x} END")] + f" WHEN {d.has(x, 'ogi$')} THEN {ogi} WHEN {d.has(x, 'li$')} THEN {li} ELSE {x} END"

                def third(x: str) -> str:
                    ative = cases([(f"{inside(x, 5, p)} AND {inside(x, 5, q)}", lead(x, 5))], x)
                    return rules(x, STEP_3, p, [(d.has(x, "ative$"), ative)])

                def fourth(x: str) -> str:
                    ion = cases([(f"{inside(x, 3, q)} AND {d.has(x, '[st]ion$')}", lead(x, 3))], x)
                    return rules(x, [(a, "") for a in STEP_4], q, [(d.has(x, "ion$"), ion)])

                def fifth(x: str) -> str:
                    e = cases([(f"{inside(x, 1, q)} OR {inside(x, 1, p)} AND NOT {d.has(lead(x, 1), short)}", lead(x, 1))], x)
                    ll = cases([(inside(x, 1, q), lead(x, 1))], x)
                    return f"lower({cases([(d.has(x, 'e$'), e), (d.has(x, 'll$'), ll)], x)})"

                tail = lambda x: d.bind(past(x), lambda a: d.bind(d.swap(a, "^(.+[^aeiouy])[yY]$", "<1>i"), lambda b: d.bind(second(b), lambda c: d.bind(third(c), lambda e: d.bind(fourth(e), fifth)))))
                return d.bind(plural(w), lambda x: cases([(d.has(x, f"^(?:{AFTER_PLURAL})$"), x)], tail(x)))

            return d.bind(f"length({w}) - length({d.after(r1, rest)})", with_r2)

        return d.bind(f"length({w}) - length({r1})", with_r1)

    known = [(f"{word} = '{a}'", f"'{b}'") for a, b in EXCEPTIONS.items()]
    return cases([*known, (f"length({word}) < 3 OR {d.has(word, f'^(?:{INVARIANT})$')}", word)], d.bind(marked(word), steps))


def stem_sql(word: str, config: str, dialect: str = "spark", stops: bool = True) -> str:
    """SQL of the lexeme of the column ``word`` (small letters) under 'russian' or 'english'.

    Stop words give '' unless ``stops`` is False.  The Russian configuration stems words of ASCII
    letters as English ones; the English one leaves other words as they are (FTS1, FTS2).
    """
    d = Dialect(dialect)
    listed = lambda words: ", ".join(f"'{w}'" for w in words)

    def one(x: str) -> str:
        without = lambda words, stem: f"CASE WHEN {x} IN ({listed(words)}) THEN '' ELSE {stem} END" if stops else stem
        other = without(RUSSIAN_STOPS, russian(x, d)) if config == "russian" else x
        return f"CASE WHEN {d.has(x, '^[a-z]+$')} THEN {without(ENGLISH_STOPS, english(x, d))} ELSE {other} END"

    return d.bind(word, one)


def stem(word: str, config: str, stops: bool = True) -> Column:
    """:func:`stem_sql` of a column named ``word``; meant for distinct words."""
    return F.expr(stem_sql(word, config, stops=stops))
