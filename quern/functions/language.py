"""Languages of texts by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (one to three characters within words, a space at either end) in order. A text's own n-grams are put
in order too; its distance from a language is how far they stand from where the profile has them, those it lacks counting as far as can be.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: n-grams of a profile and of a text; characters that are looked at and needed; texts looked at together.
MOST, READ, LEAST, ROWS = 300, 2000, 50, 512
LETTERS = r"[^\p{L}]+"

#: Plain sentences that the built-in profiles are made of.
SAMPLES = {
    "de": """Die Stadt liegt an einem breiten Fluss, der aus den Bergen kommt und sich nach Norden wendet. Am Morgen gehen viele Menschen über die alte Brücke zur Arbeit,
        während die Händler auf dem Markt ihre Stände aufbauen. Wer etwas Zeit hat, setzt sich in eines der kleinen Cafés und liest die Zeitung oder spricht mit den Nachbarn. Früher
        gab es hier nur wenige Häuser, doch in den letzten Jahren ist der Ort schnell gewachsen. Es wurden neue Straßen gebaut, und auch die Schule ist größer geworden. Trotzdem
        kennen sich die meisten noch, und wenn jemand Hilfe braucht, dann findet sich immer einer, der sie gibt. Nicht alles ist besser als zuvor, aber man lebt gern hier und möchte bleiben.""",
    "en": """The town lies on a broad river that comes down from the hills and then turns towards the north. In the morning many people walk across the old bridge to their work,
        while the traders set up their stalls on the market square. Those who have some time sit down in one of the small cafés and read the paper or talk with their neighbours. There
        were only a few houses here before, but the place has grown quickly over the last years. New roads have been built, and the school has become larger as well. Even so most of
        them still know each other, and when somebody needs help there is always one who will give it. Not everything is better than it was, but they like living here and want to stay.""",
    "es": """La ciudad está junto a un río ancho que baja de las montañas y luego se vuelve hacia el norte. Por la mañana mucha gente cruza el puente viejo para ir al trabajo,
        mientras los vendedores montan sus puestos en la plaza del mercado. Quien tiene algo de tiempo se sienta en uno de los pequeños cafés y lee el periódico o habla con los vecinos.
        Antes había aquí solo unas pocas casas, pero en los últimos años el lugar ha crecido muy deprisa. Se han construido calles nuevas y también la escuela se ha hecho más grande. Aun así
        la mayoría se conoce todavía, y cuando alguien necesita ayuda siempre hay otro que se la da. No todo es mejor que antes, pero a ellos les gusta vivir aquí y quieren quedarse.""",
    "fr": """La ville se trouve au bord d'un large fleuve qui descend des montagnes et tourne ensuite vers le nord. Le matin, beaucoup de gens passent le vieux pont pour aller au travail,
        pendant que les marchands installent leurs étals sur la place du marché. Celui qui a un peu de temps s'assoit dans un des petits cafés et lit le journal ou parle avec ses voisins. Il
        n'y avait autrefois que quelques maisons ici, mais dans les dernières années le lieu a grandi très vite. On a construit de nouvelles rues, et l'école aussi est devenue plus grande. Pourtant
        la plupart se connaissent encore, et quand quelqu'un a besoin d'aide, il y en a toujours un qui la donne. Tout n'est pas meilleur qu'avant, mais on aime vivre ici et on veut rester.""",
    "it": """La città si trova sulla riva di un largo fiume che scende dalle montagne e poi gira verso il nord. La mattina molta gente attraversa il vecchio ponte per andare al lavoro,
        mentre i mercanti preparano i loro banchi nella piazza del mercato. Chi ha un po' di tempo si siede in uno dei piccoli caffè e legge il giornale oppure parla con i vicini. Prima c'erano qui
        soltanto poche case, ma negli ultimi anni il luogo è cresciuto molto in fretta. Sono state costruite nuove strade, e anche la scuola è diventata più grande. Eppure la maggior parte si conosce
        ancora, e quando qualcuno ha bisogno di aiuto c'è sempre uno che glielo dà. Non tutto è migliore di prima, ma a loro piace vivere qui e vogliono rimanere.""",
    "nl": """De stad ligt aan een brede rivier die uit de bergen komt en zich daarna naar het noorden keert. 's Morgens lopen veel mensen over de oude brug naar hun werk, terwijl de
        handelaars op het marktplein hun kramen opbouwen. Wie wat tijd heeft, gaat in een van de kleine cafés zitten en leest de krant of praat met de buren. Vroeger stonden hier maar een paar
        huizen, maar in de laatste jaren is de plaats snel gegroeid. Er zijn nieuwe wegen aangelegd en ook de school is groter geworden. Toch kennen de meesten elkaar nog, en als iemand hulp nodig
        heeft, is er altijd wel een die hem die geeft. Niet alles is beter dan het was, maar zij wonen hier graag en willen blijven.""",
    "pt": """A cidade fica junto de um rio largo que desce das montanhas e depois se volta para o norte. De manhã muita gente atravessa a ponte velha para ir ao trabalho, enquanto
        os vendedores montam as suas bancas na praça do mercado. Quem tem algum tempo senta-se num dos pequenos cafés e lê o jornal ou fala com os vizinhos. Antes havia aqui apenas algumas casas, mas
        nos últimos anos o lugar cresceu muito depressa. Foram construídas novas ruas, e também a escola ficou maior. Mesmo assim a maior parte ainda se conhece, e quando alguém precisa de ajuda há
        sempre outro que a dá. Nem tudo é melhor do que era, mas eles gostam de viver aqui e querem ficar.""",
}


def _padded(text: str) -> str:
    """Words in lower case, one space before and after each; everything but letters parts them."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def _grams(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all n-grams of texts in code points end to end; those over a space or of a space alone are none."""
    codes, at, space = [], [], points == 32
    for n in (1, 2, 3):
        m = len(points) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.int64)
        for k in range(n):
            code = (code << 21) | points[k : k + m]
        good = rows[:m] == rows[n - 1 :]
        if n == 1:
            good &= ~space
        elif n == 2:
            good &= ~(space[:-1] & space[1:])
        else:
            good &= ~space[1:-1]
        codes.append(code[good])
        at.append(rows[:m][good])
    return np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(codes) if codes else np.zeros(0, np.int64)


def ranked(texts: list[str], most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, rank from 0) of each text's most frequent n-grams; equally frequent ones by code."""
    padded = [_padded(t) for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows, codes = _grams(points, np.repeat(np.arange(len(texts)), [len(p) for p in padded]))
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(rows)))
    rows, codes = rows[at], codes[at]
    order = np.lexsort((codes, -counts, rows))
    rows, codes = rows[order], codes[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < most
    return rows[keep], codes[keep], rank[keep]


@dataclass(frozen=True)
class Profiles:
    """Profiles of some languages: all their n-grams, rising, and each language's rank for them, ``most`` where it has none."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    most: int

    @staticmethod
    def of(rows: list[tuple[str, str, int]], most: int = MOST) -> Profiles:
        """From (language, n-gram, rank from 0)."""
        languages = tuple(sorted({r[0] for r in rows}))
        code = [sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g)) for _, g, _ in rows]
        codes, at = np.unique(np.array(code, np.int64), return_inverse=True)
        ranks = np.full((len(languages), len(codes)), most, np.int64)
        ranks[[languages.index(r[0]) for r in rows], at] = [r[2] for r in rows]
        return Profiles(languages, codes, ranks, most)

    def guess(self, texts: list[str | None]) -> list[str | None]:
        """The nearest language of each text by its first ``READ`` characters; null for texts under ``LEAST`` characters, without letters, or as near to two."""
        out: list[str | None] = [None] * len(texts)
        fit = [i for i, t in enumerate(texts) if t and len(t.strip()) >= LEAST]
        for begin in range(0, len(fit), ROWS):
            block = fit[begin : begin + ROWS]
            rows, codes, rank = ranked([texts[i].strip()[:READ] for i in block], self.most)
            if not len(codes) or not self.languages:
                continue
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            theirs = np.where(self.codes[at] == codes, self.ranks[:, at], self.most)
            away = np.where(theirs < self.most, np.abs(theirs - rank), self.most)
            total = np.stack([np.bincount(rows, a, len(block)) for a in away])
            some = np.bincount(rows, minlength=len(block)) > 0
            best = total.argmin(0)
            alone = (total == total.min(0)).sum(0) == 1
            for k, i in enumerate(block):
                if some[k] and alone[k]:
                    out[i] = self.languages[best[k]]
        return out


@lru_cache(maxsize=1)
def built_in() -> Profiles:
    """Profiles of the languages of ``SAMPLES``."""
    names = sorted(SAMPLES)
    rows, codes, rank = ranked([SAMPLES[n] for n in names])
    gram = lambda c: "".join(chr((c >> s) & 0x1FFFFF) for s in (42, 21, 0) if c >> s)
    return Profiles.of([(names[r], gram(c), k) for r, c, k in zip(rows.tolist(), codes.tolist(), rank.tolist(), strict=True)])


def guessed(text: Column | str, profiles: Profiles | None = None) -> Column:
    """The language of texts, whole Arrow batches at a time."""

    def run(s):
        import pandas as pd

        return pd.Series((profiles or built_in()).guess([t if isinstance(t, str) else None for t in s]), dtype=object)

    return F.pandas_udf(run, "string")(text)


def _cut(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def profiles_of(texts: DataFrame, language: str = "lang", text: str = "text", most: int = MOST) -> DataFrame:
    """(language, gram, rank): profiles learned from all of ``texts`` of known language, the whole texts.

    Words are counted before they are taken apart, so what is shuffled is words and n-grams of each language with their counts. Equally frequent n-grams
    are in their order; rank from 0.
    """
    words = texts.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(F.split(F.regexp_replace(F.lower(F.col(text)), LETTERS, " "), " ")).alias("word"))
    words = words.filter("word <> ''").groupBy("language", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    # all n-grams of a padded word but the spaces alone
    ranges = ((1, 2, 1), (2, 1, 1), (3, 1, 0))  # n, first place, last place beyond the word's length
    grams = [F.transform(F.sequence(F.lit(a), F.length("word") + b), _cut(padded, n)) for n, a, b in ranges]
    counted = words.select("language", "n", F.explode(F.concat(*grams)).alias("gram")).groupBy("language", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", (place - 1).cast("bigint")).filter(F.col("rank") < most).select("language", "gram", "rank")


def learned(texts: DataFrame, language: str = "lang", text: str = "text", most: int = MOST) -> Profiles:
    """``profiles_of`` as a model: ``most`` rows for each language come to the driver."""
    return Profiles.of([(r["language"], r["gram"], r["rank"]) for r in profiles_of(texts, language, text, most).collect()], most)
