"""Problem 5: defective translation pairs and the kind of their defect.

A multi-label linear classifier. Three logistic models over hashed byte n-grams tell whether a target is not English,
whether it refuses or asks back, and whether a source may be repeated as it is (English, names, codes). A second layer,
one logistic model a defect, weighs their scores together with features of the pair: content, open or marked endings,
ratios of sentences and lengths, sameness of source and target. It is trained on good pairs of a bounded sample, with a few
fixed ones (``SEEDS``) for where the sample has hardly any, and on their synthetically blanked, cut, shortened, copied,
swapped and refused versions. The pairs are split before anything is fitted, copies of a text on one side, and so are the
phrases of refusals: on those held out each defect's threshold is calibrated. Everything is then scored, whole.

Defined cases: a source without a letter has nothing to translate and no defect; a null or blank target of any other
source is ``empty``; one defect a pair, the one furthest over its threshold; a table without any pair to trust is judged by
what the fixed pairs teach.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import _TABLE, blocks, packed
from .visual_forms import _suspect, unify

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Bounds of the sample of whole pairs the classifier is fitted on, in pairs and in characters of both sides, and the share
#: of it held out to calibrate thresholds.
SAMPLE_ROWS, SAMPLE_CHARS, HELD_OUT = 9_000, 16_000_000, 0.25
#: Pairs the second layer, of 28 weights a defect, is fitted on at most.
LAYER_PAIRS = 3_000
GRAM, BITS, SCALE = 5, 18, 24.0
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Fillers that stand for no translation; phrases to build refusals from.
PLACEHOLDERS = {
    "n a", "na", "null", "none", "nan", "nil", "tbd", "tba", "todo", "empty", "missing", "xxx", "xx", "x", "blank",
    "not available", "no translation", "untranslated", "not translated", "translation", "undefined", "no text",
}
_openers = (
    "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologize, but ", "My apologies, ", "Regrettably ",
    "I'm afraid ", "As an AI model ", "As a translator ", "Apologies: ",
)
_cores = (
    "I cannot translate this text.", "I can't help with this request.", "I am unable to provide a translation.",
    "I am not able to process the given input.", "I won't be able to assist with that.", "I can not do that.",
    "I must decline to translate this content.", "this passage cannot be translated.", "a translation is not possible.",
    "the language of the input is not supported.", "the supplied text appears to be damaged.", "this request is outside what I can do.",
    "it would not be appropriate to translate this record.", "this content violates the guidelines and will not be translated.",
    "the model declined to answer.", "I do not have enough context to translate this fragment.", "no translation can be given.",
    "I will not translate details of this kind.", "the segment could not be translated.", "I don't understand the text.",
)
_asks = (
    "Please provide the text you would like me to translate.", "Could you provide more context?", "Could you supply the whole text?",
    "What would you like me to translate?", "Which language do you mean?", "Please send the passage again.", "Can you clarify your request?",
)
_foreign = (
    "Omlouvám se, ale tento text nemohu přeložit.", "Bohužel nemohu poskytnout překlad.", "Překlad tohoto textu není možný.",
    "Prosím, zadejte text, který mám přeložit.", "Prepáčte, ale tento text nemôžem preložiť.", "Žiaľ, preklad nie je možný.",
    "Prosím, zadajte text na preklad.", "Przepraszam, ale nie mogę przetłumaczyć tego tekstu.", "Niestety tłumaczenie nie jest możliwe.",
    "Proszę podać tekst do przetłumaczenia.", "Es tut mir leid, diesen Text kann ich nicht übersetzen.",
    "Leider ist eine Übersetzung nicht möglich.", "Bitte geben Sie den Text ein, den ich übersetzen soll.",
    "На жаль, я не можу перекласти цей текст.", "Вибачте, але переклад неможливий.", "Будь ласка, надайте текст для перекладу.",
)
# Pairs to learn from where there are hardly any, and sources that may be repeated.
SEEDS = (
    ("Stěny domu byly natřeny na bílo.", "The walls of the house were painted white."),
    ("Dopis přišel až po třech týdnech. Nikdo na něj neodpověděl.", "The letter only came after three weeks. Nobody answered it."),
    ("U cesty stála stará studna s kamenným okrajem.", "By the road stood an old well with a stone rim."),
    ("Zpráva byla uložena v archivu města. Opis se nedochoval.", "The report was kept in the town archive. No copy has survived."),
    ("hliněná nádoba", "clay vessel"),
    ("Voda v potoce bola studená a číra.", "The water in the brook was cold and clear."),
    ("Deti našli pri ceste starú mincu. Odniesli ju učiteľovi.", "The children found an old coin by the road. They took it to the teacher."),
    ("Strecha kostola bola opravená pred zimou.", "The roof of the church was repaired before winter."),
    ("železný kľúč", "iron key"),
    ("Most nad rzeką został zbudowany z drewna.", "The bridge over the river was built of wood."),
    ("Mieszkańcy wsi pamiętali wielki pożar. Spłonęły wtedy wszystkie stodoły.", "The people of the village remembered the great fire. All the barns burned down then."),
    ("W skrzyni leżały stare książki i mapy.", "Old books and maps lay in the chest."),
    ("gliniane naczynie", "clay vessel"),
    ("Der Garten hinter dem Haus war groß und still.", "The garden behind the house was large and quiet."),
    ("Die Karte wurde im Jahr darauf gedruckt. Sie zeigt alle Wege.", "The map was printed in the following year. It shows all the paths."),
    ("Am Abend kehrten die Arbeiter in das Dorf zurück.", "In the evening the workers returned to the village."),
    ("eiserner Nagel", "iron nail"),
    ("Стара хата стояла на краю села.", "The old house stood at the edge of the village."),
    ("Лист прийшов навесні. Його прочитали вголос усій родині.", "The letter came in spring. It was read aloud to the whole family."),
    ("Дорога до міста була довга і важка.", "The road to the town was long and hard."),
    ("глиняний горщик", "clay pot"),
    ("Dolní Mlýn", "Dolní Mlýn"), ("Nowy Dwór", "Nowy Dwór"), ("Oberndorf", "Oberndorf"), ("XIV/7 c", "XIV/7 c"), ("KNB", "KNB"), ("Novák", "Novák"), ("inv. č. 12", "inv. č. 12"),
    ("The walls of the church were white.", "The walls of the church were white."),
    ("The letter was found in the town archive. It had no date.", "The letter was found in the town archive. It had no date."),
    ("The bridge was built of stone and wood.", "The bridge was built of stone and wood."),
)
_prefixes = ("", "", "", "Note: ", "Translation: ", "Hello! ", "EN: ", "Segment {}: ", "Answer: ")

_split = re.compile(r"(?<=[.!?…])[\"”'»)\]]*\s+(?=[^\W\d_a-zß-öø-ÿа-яіїєґ]|[\"„“«(/])")
_heading = re.compile(r"(?m)^\W*(?:\d{1,2}|inv|str|s|p|S)\.\s")
_closed = re.compile(r"[.!?…][\"”'’»“)\]]*$")
_marked = re.compile(r"(?:…|\.\.\.|\[\s*…?\s*\]?|\[\.\.\.\])$")
_not_word = re.compile(r"[\W_]+")
_letter = re.compile(r"[^\W\d_]")
_number = re.compile(r"\d+")
_last = re.compile(r"[^\W_](?=[\W_]*$)")
_nonletters = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Case, width, marks and spacing taken away."""
    return _not_word.sub(" ", unicodedata.normalize("NFKC", text).casefold()).strip()


def sentences(text: str) -> int:
    t = text.strip()
    return max(1, 1 + len(_split.findall(t)) - len(_heading.findall(t))) if t else 0


def same(source: str, target: str) -> bool:
    """The target repeats the source, apart from case, spacing, final mark or a prefix of its own."""
    if not target or len(target) + 12 < len(source) * 0.9 or _ends_apart(source, target):
        return False
    a, b = plain(source[-24:]).replace(" ", "")[-8:], plain(target[-24:]).replace(" ", "")[-8:]
    n = min(len(a), len(b))
    if not n or a[-n:] != b[-n:]:
        return False
    a, b = plain(source), plain(target)
    return bool(a) and (a == b or (b.endswith(" " + a) and len(b) - len(a) <= 24 and not sentences_before(target, source)))


def _ends_apart(a: str, b: str) -> bool:
    """Whether the last letters or digits of two texts are plain ones and differ: a quick way to tell most pairs apart."""
    x, y = _last.search(a[-12:]), _last.search(b[-12:])
    return bool(x and y) and x[0].isascii() and y[0].isascii() and x[0].lower() != y[0].lower()


def letters_only(text: str) -> str:
    """The consistent form of a text without digits and marks: what decides whether it may be repeated."""
    return _nonletters.sub(" ", unify(text) if _suspect.search(text) else text).strip()


def sentences_before(target: str, source: str) -> bool:
    """Whether what stands before the repeated source is a sentence of its own rather than a prefix."""
    lead = plain(target)[: -len(plain(source))].strip()
    return len(lead.split()) > 3


def slots(data: np.ndarray) -> np.ndarray:
    return ((packed(data, GRAM) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def gram_means(texts: list[str], weights: np.ndarray, known_only: bool = False) -> np.ndarray:
    """Mean weight of the n-grams of each text, by column of ``weights``; of those met in training, if ``known_only``."""
    pad = b" " * (GRAM - 1)
    out = np.zeros((len(texts), weights.shape[1]), dtype=np.float32)
    for a, b in blocks(texts, 400_000):
        raw = [pad + t.encode("utf-8", "replace").translate(_TABLE) + b" " for t in texts[a:b]]
        sizes = np.array([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if len(data) < GRAM:
            continue
        got = weights[slots(data)]  # gram i ends at byte i + GRAM - 1
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(2 * len(sizes), dtype=np.int64)
        flat[0::2], flat[1::2] = starts, np.minimum(starts + sizes - (GRAM - 1), len(got) - 1)
        for c in range(weights.shape[1]):
            column = np.ascontiguousarray(got[:, c])
            n = np.add.reduceat((column != 0).astype(np.int64), flat)[0::2] if known_only else sizes - (GRAM - 1)
            out[a:b, c] = np.add.reduceat(column, flat)[0::2] / np.maximum(1, n)
    return out


def fit_grams(texts: list[str], y: np.ndarray, seed: int, epochs: int = 4) -> np.ndarray:
    """Weights of a logistic model over the mean of hashed n-grams (adaptive gradient steps)."""
    pad = b" " * (GRAM - 1)
    docs = [slots(np.frombuffer(pad + t.encode("utf-8", "replace").translate(_TABLE) + b" ", dtype=np.uint8)) for t in texts]
    w = np.zeros(1 << BITS, dtype=np.float64)
    g2 = np.full(1 << BITS, 1e-6)
    rng = np.random.default_rng(seed)
    positive = max(1, int(y.sum()))
    importance = np.where(y > 0, len(y) / (2.0 * positive), len(y) / (2.0 * max(1, len(y) - positive)))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), 256):
            part = order[i : i + 256]
            lens = np.array([len(docs[j]) for j in part])
            flat = np.concatenate([docs[j] for j in part])
            owner = np.repeat(np.arange(len(part)), lens)
            z = SCALE * np.bincount(owner, weights=w[flat], minlength=len(part)) / np.maximum(1, lens)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * np.minimum(importance[part], 20)
            g = np.bincount(flat, weights=(SCALE * err / np.maximum(1, lens))[owner], minlength=1 << BITS) / len(part)
            g2 += g * g
            w -= 0.5 * g / np.sqrt(g2)
    return w.astype(np.float32)


def features(sources: list[str], targets: list[str], scores: np.ndarray, copyable: np.ndarray, known: set[str]) -> np.ndarray:
    """One row of pair features a pair; ``scores``: not English, refusal; ``copyable``: of repeated sources, else 0."""
    rows = np.zeros((len(sources), 28), dtype=np.float64)
    copied = (1 / (1 + np.exp(-np.clip(SCALE * copyable, -30, 30)))).tolist()
    scaled = np.clip(scores.astype(np.float64) * SCALE, -8, 8).tolist()
    for i, (a, e) in enumerate(zip(sources, targets)):
        r = rows[i]
        r[0] = 1
        tail, end = a.rstrip()[-24:], e.rstrip()[-24:]
        short = len(e) < 40
        p = plain(e) if short else "-"
        r[1] = 3 * (not p)
        r[2] = 3 * (bool(p) and p in PLACEHOLDERS)
        closed_a, closed_e = bool(_closed.search(tail)), bool(_closed.search(end))
        marked = bool(_marked.search(end)) and not _marked.search(tail)
        quick_a, quick_e = a.count(". ") + a.count(".\n") + 1, e.count(". ") + e.count(".\n") + 1
        ratio = (len(e.strip()) + 1) / (len(a.strip()) + 1)
        if quick_e >= 0.75 * quick_a and ratio > 0.6:
            n_a, n_e = quick_a, quick_e
        else:
            n_a, n_e = sentences(a), sentences(e)
            if n_a >= 2 and not closed_a:  # a last line without end may be furniture that needs no translation
                n_a -= 1
        open_end = not closed_e and not marked
        r[3] = open_end and closed_a
        r[4] = open_end and n_e >= 2
        r[5] = marked
        r[6] = open_end and not closed_a
        r[7] = n_a >= 2 and n_e <= 0.5 * n_a
        r[8] = n_a >= 2 and 0.5 * n_a < n_e <= 0.67 * n_a
        r[9], r[10], r[11], r[12] = ratio < 0.3, 0.3 <= ratio < 0.5, 0.5 <= ratio < 0.65, ratio > 1.7
        is_same = same(a, e)
        r[13] = is_same
        c = copied[i]
        r[14] = is_same * (1 - c) * 4
        r[15] = is_same * c * 4
        r[16], r[17] = scaled[i]
        r[18] = len(e) < 12
        r[19] = (r[9] or r[10]) and (open_end or marked) and closed_a
        r[20] = max(0.0, scaled[i][0]) * (1 - is_same)
        r[21] = max(0.0, scaled[i][1]) * (1 - is_same)
        r[22] = not closed_e and len(a) > 60 and n_e >= 2
        r[23] = open_end and not closed_a and ratio < 0.5 and len(a) > 25
        if not closed_a and len(a) > 25:
            n_a, n_e = a.count(",") + a.count(";"), e.count(",") + e.count(";")
            r[24] = n_a >= 2 and n_e < n_a and open_end
        if is_same and len(a) <= 60:
            r[25] = 3 * (_number.sub("0", plain(a)) in known)
            r[26] = 3 * (a[:1].isupper() and len(a.split()) == 1 and not r[25])
    return rows


def fit_layer(x: np.ndarray, y: np.ndarray, steps: int = 600) -> np.ndarray:
    """Weights of one logistic model a column of ``y`` (full gradient, Adam)."""
    w = np.zeros((x.shape[1], y.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.clip(x @ w, -30, 30)
        g = x.T @ (1 / (1 + np.exp(-z)) - y) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def phrases(known: bool | None) -> list[list[str]]:
    """The phrases refusals are built from: all, all but every fourth (``True``) or these (``False``)."""
    return [[p for i, p in enumerate(x) if known is None or (i % 4 != 3) == known] for x in (_cores, _asks, _foreign)]


def refusal(rng: random.Random, fragment: str, known: bool | None) -> str:
    cores, asks, foreign = phrases(known)
    kind = rng.random()
    if kind < 0.2:
        text = rng.choice(foreign)
    elif kind < 0.4:
        text = rng.choice(("", "Hello! ", "Sorry. ", rng.choice(cores) + " ")) + rng.choice(asks)
    else:
        opener = rng.choice(_openers)
        core = rng.choice(cores)
        text = opener + core if opener else core[0].upper() + core[1:]
    text = rng.choice(_prefixes).format(rng.randrange(400)) + text
    if rng.random() < 0.1:
        text += f" ({fragment[:24]})"
    return text.lower() if rng.random() < 0.12 else text


def damaged(rng: random.Random, a: str, e: str, other: str, known: bool | None) -> list[tuple[str, str, str]]:
    """Defective versions of a good pair: (source, target, defect); ``known`` chooses among the phrases of refusals."""
    out = [(a, rng.choice(("", " ", "\n", "\u00a0", "\u200b", "\ufeff", "...", "…", "-", "—", "[]", "???", *sorted(PLACEHOLDERS))), "empty")]
    out.append((a, refusal(rng, a, known), "refusal"))
    if other:
        out.append((a, other, "language"))
    if len(e) > 40:
        at = rng.randrange(max(8, len(e) // 12), len(e) - 3)
        cut = e[:at].rstrip()
        if not _closed.search(cut):
            out.append((a, cut + rng.choice(("", "", "", "…", "...", " [", "[...]")), "truncated"))
    parts = re.split(r"(?<=[.!?])\s+", e)
    if len(parts) >= 2:
        keep = rng.randint(1, len(parts) // 2)
        out.append((a, " ".join(parts[:keep]), "truncated"))
    shape = rng.choice((str, str, str.upper, str.lower, lambda s: s.rstrip(".!? "), lambda s: "Translation: " + s, lambda s: "EN: " + s, lambda s: "  ".join(s.split(" "))))
    out.append((a, shape(a), "copy"))
    return out


class Pairs:
    """The fitted classifier; ``f1`` is that of its defects on pairs and phrases it has not seen."""

    def __init__(self, sample: list[tuple[str, str]], seed: int = 11):
        rng = random.Random(seed)
        good, repeated = trusted([(a, e or "") for a, e in sample if a and _letter.search(a)])
        codes = [e for _, e in repeated if 2 * len(letters_only(e)) < len(e)]
        good = self.sound(rng, good, codes)
        taught, held = ([], []), ([], [])
        for pairs, kind in ((good, 0), (repeated, 1)):
            for a, e in pairs:
                at = zlib.crc32(_number.sub("0", plain(a)).encode()) % 1000 / 1000
                (held if at < HELD_OUT else taught)[kind].append((a, e))
        for i, (a, e) in enumerate(SEEDS):
            (held if i % 4 == 3 else taught)[a == e].append((a, e))
        y = lambda *n: np.concatenate([np.full(k, v, dtype=float) for k, v in n])
        # thresholds by what is not seen, pairs and phrases; then everything is learned
        self.learn(rng, *taught, True)
        x, label = self.examples(rng, held[0], self.native(held[1]), False)
        z = x @ self.layer
        self.thresholds = np.array([_calibrated(z[:, k], label[:, k]) for k in range(len(DEFECTS))])
        self.f1 = {d: _f1(z[:, k] >= self.thresholds[k], label[:, k] > 0) for k, d in enumerate(DEFECTS)}
        self.learn(rng, taught[0] + held[0], taught[1] + held[1], None)

    def sound(self, rng: random.Random, good: list, codes: list[str]) -> list:
        """Pairs less those that models fitted on the other half of them find defective: a few wrong examples are soon learned
        by heart."""
        out = []
        halves = [[p for i, p in enumerate(good) if i % 2 == k] for k in (0, 1)]
        for mine, other in (halves, halves[::-1]):
            self.fit_targets(rng, [*other, *[p for p in SEEDS if p[0] != p[1]]], codes, None, 2)
            scores = gram_means([e for _, e in mine], self.target_weights).max(axis=1)
            out += [p for p, z in zip(mine, scores) if z <= 0]
        return out

    def fit_targets(self, rng: random.Random, good: list, codes: list[str], known: bool | None, epochs: int = 4) -> None:
        """Fit the models of targets: not English (which codes are not, either), refusing."""
        sources, targets = [a for a, _ in good], [e for _, e in good]
        refused = [refusal(rng, a, known) for a in sources for _ in range(2)][:8000]
        foreign = fit_grams([*targets, *codes, *sources], np.repeat([0.0, 1.0], [len(targets) + len(codes), len(sources)]), 1, epochs)
        declined = fit_grams([*targets, *sources, *refused], np.repeat([0.0, 1.0], [2 * len(sources), len(refused)]), 2, epochs)
        self.target_weights = np.stack([foreign, declined], axis=1)

    def learn(self, rng: random.Random, good: list, repeated: list, known: bool | None) -> None:
        """Fit all models; refusals are built from the phrases that ``known`` chooses."""
        self.fit_targets(rng, good, [e for _, e in repeated if 2 * len(letters_only(e)) < len(e)], known)
        sources = [a for a, _ in good]
        repeated = self.native(repeated)
        spelled = [letters_only(a) for a in [*sources, *[a for a, _ in repeated]]]
        self.copy_weights = fit_grams(spelled, np.repeat([0.0, 1.0], [len(sources), len(repeated)]), 3)[:, None]
        self.known = {_number.sub("0", plain(a)) for a in sources if len(a) <= 60}
        some = rng.sample(good, min(LAYER_PAIRS, len(good)))
        self.layer = fit_layer(*self.examples(rng, some, repeated[: len(some)], known))

    def native(self, pairs: list) -> list:
        """Repeated sources without long ones in another language: these are copies themselves and teach nothing."""
        alien = gram_means([a for a, _ in pairs], self.target_weights)[:, 0]
        return [p for p, z in zip(pairs, alien) if len(p[0]) <= 60 or z < 0]

    def examples(self, rng: random.Random, good: list, repeated: list, known: bool | None) -> tuple[np.ndarray, np.ndarray]:
        """(features, defects) of good pairs and their damaged versions."""
        rows = [(a, e, "") for a, e in [*good, *repeated]]
        others = [a for a, _ in good]
        rng.shuffle(others)
        for (a, e), other in zip(good, others):
            rows += damaged(rng, a, e, other if plain(other) != plain(a) and len(other) < 4 * len(a) + 40 else "", known)
        return self.of([a for a, _, _ in rows], [e for _, e, _ in rows]), np.array([[d == k for k in DEFECTS] for _, _, d in rows], dtype=float)

    def of(self, sources: list[str], targets: list[str]) -> np.ndarray:
        scores = gram_means(targets, self.target_weights)
        copyable = np.zeros(len(sources))
        at = [i for i, (a, e) in enumerate(zip(sources, targets)) if same(a, e)]
        if at:
            copyable[at] = gram_means([letters_only(sources[i]) for i in at], self.copy_weights, True)[:, 0]
        return features(sources, targets, scores, copyable, self.known)

    def defects(self, sources: list[str], targets: list[str]) -> list[str | None]:
        over = self.of(sources, targets) @ self.layer - self.thresholds
        best = over.argmax(axis=1)
        return [DEFECTS[k] if over[i, k] >= 0 else None for i, k in enumerate(best.tolist())]


def trusted(sample: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(pairs to trust, sources that are mostly repeated) of a sample: alike in length, end and numbers, with some content."""
    masked: dict[str, list[bool]] = {}
    for a, e in sample:
        masked.setdefault(_number.sub("0", plain(a)), []).append(same(a, e))
    good, repeated = [], []
    for a, e in sample:
        alike = masked[_number.sub("0", plain(a))]
        if 2 * sum(alike) > len(alike):  # a source of this form is mostly repeated
            if same(a, e):
                repeated.append((a, e))
            continue
        if same(a, e):
            continue
        numbers = set(_number.findall(a))
        kept = len(numbers & set(_number.findall(e))) >= 0.8 * len(numbers)
        ratio = (len(e) + 1) / (len(a) + 1)
        ends = bool(_closed.search(e.rstrip())) or (not _closed.search(a.rstrip()) and sentences(e) < 2)
        if kept and plain(e) and 0.4 < ratio < 2.5 and ends and sentences(e) > 0.67 * (sentences(a) - (not _closed.search(a.rstrip()))):
            good.append((a, e))
    return good, repeated


def _f1(said: np.ndarray, true: np.ndarray) -> float:
    hit = (said & true).sum()
    return float(2 * hit / max(1, said.sum() + true.sum()))


def _calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; among equals the middle, no lower than even odds."""
    steps = np.linspace(0.0, 8.0, 81)
    f = np.array([_f1(z >= t, y > 0) for t in steps])
    best = np.flatnonzero(f >= f.max() - 5e-4)
    return float(steps[best[len(best) // 2]])


def fit(log: DataFrame, key: str, source: str, target: str) -> Pairs:
    """The classifier from a bounded sample of whole pairs of any length, chosen by a hash of the key."""
    usable = log.where(F.length(source) > 0).select(F.col(key).alias("k"), F.col(source).alias("a"), F.col(target).alias("e"))
    size = F.length("a") + F.coalesce(F.length("e"), F.lit(0))
    total, chars = usable.agg(F.count("*"), F.sum(size)).first()
    share = min(1.0, SAMPLE_ROWS / max(1, total), SAMPLE_CHARS / max(1, chars or 0))
    picked = usable.where(F.pmod(F.xxhash64(F.lit(41), "k"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    rows = picked.limit(2 * SAMPLE_ROWS).collect()
    return Pairs([(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1]))])


def defective(log: DataFrame, model: Pairs, key: str, source: str, target: str) -> DataFrame:
    """(``k``, ``defect``) of every defective pair."""
    shared = log.sparkSession.sparkContext.broadcast(model)  # three tables of 2 ** BITS weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a, e = (c.to_pylist() for c in batch.columns)
            at = [i for i, x in enumerate(a) if _letter.search(x)]
            found = shared.value.defects([a[i] for i in at], [e[i] or "" for i in at])
            rows = [(keys[i], d) for i, d in zip(at, found) if d]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["k", "defect"]
                )

    pairs = log.where(F.length(source) > 0).select(F.col(key).alias("k"), F.col(source).alias("a"), F.col(target).alias("e"))
    return pairs.mapInArrow(score, "k long, defect string")
