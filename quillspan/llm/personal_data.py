"""Problem 7: personal data in free text by a semi-Markov conditional random field.

Candidate segments of a text are whole spans (addresses of mail, numbers, street lines, runs of name-like words) with
features of the whole span and of its surroundings. A segment's score for a type is a weighted sum of its features; the
best set of disjoint typed segments is found by dynamic programming over the candidates' ends, everything outside being
"other" at no score, so boundaries and types are chosen jointly. Weights are trained on labelled texts that
`training_texts` builds from templates and given name parts, by stochastic gradients of the conditional likelihood, whose
partition function runs over the same candidates.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.pair_defects import WORDS
from quillspan.plans.once import once
from quillspan.sources.tables import table

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Labelled texts that the model is trained on, passes over them, and the seed of both.
TRAINING_TEXTS = 900
PASSES = 4
SEED = 7

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+\-]*\s?(?:@|\s?[\[(]\s?(?:at|AT)\s?[\])]\s?)\s?[A-Za-z0-9\-]+(?:(?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?)[A-Za-z0-9\-]+)*")
_NUMBER = re.compile(r"(?<![\w@.#/\-])(?:\+|\(\+?)?\d(?:[ .\-/()]{0,2}\d){5,24}(?![\w@])|(?<![\w@])\(\d{3,5}\)[ .\-]?\d(?:[ .\-/]?\d){4,10}(?!\w)|(?<!\w)[A-Z]{1,3} ?\d{2}(?: ?[A-Z0-9]{2,4}){2,8}(?!\w)|(?<!\w)[A-Z]{1,3}\d{6,9}(?!\w)")
# Words of streets and buildings before or after their name, in the languages of the texts.
STREETS_AFTER = "St|Street|Ave|Avenue|Rd|Road|Ln|Lane|Blvd|Boulevard|Dr|Drive|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Close|Crescent|Row|Walk|Hill|Parkway|Pkwy"
STREETS_BEFORE = "rue|avenue|av\\.?|boulevard|bd\\.?|place|allée|chemin|impasse|quai|cours|route|calle|c/|avenida|avda\\.?|paseo|plaza|camino|ronda|carrer|travesía|via"
STREETS_WITHIN = "straße|strasse|str\\.|weg|allee|platz|gasse|ring|ufer|damm|chaussee|stieg|pfad|steig|markt|hof"
_WORD = r"[A-ZÄÖÜÉÈÀÇÑ][\w'’\-]*"
_ADDRESS = re.compile(
    rf"(?<![\w.])\d{{1,5}}[A-Za-z]?,? (?:{_WORD} ){{1,3}}(?:{STREETS_AFTER})\b\.?(?:,? (?:Apt|Suite|Unit|Flat|No)\.? ?\w+)?"
    rf"|(?<![\w.])\d{{1,5}}(?: ?(?:bis|ter|[A-Za-z]))?,? (?:{STREETS_BEFORE}) (?:(?:de|du|des|de la|d['’]|del|la|le|les|los|las) ?)*{_WORD}(?: {_WORD}){{0,2}}"
    rf"|(?<!\w)(?i:{STREETS_BEFORE}) (?:(?:de|del|de la|du|des|la|los|las) )*{_WORD}(?: {_WORD}){{0,2}},? (?:n[.º°]*\s?)?\d{{1,4}}(?: ?[A-Za-z](?!\w))?"
    rf"|(?<!\w){_WORD}(?: {_WORD})?[ -]?(?:(?<=[a-zäöüß])|(?=[A-Z]))(?:{STREETS_WITHIN}|Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Ufer|Damm) \d{{1,4}}(?: ?[a-z](?!\w))?"
)
#: Postal part after an address: a comma, a code and a town in any order.
_TOWN = re.compile(rf"(?:,? (?:\d{{4,5}}(?:-\d{{4}})?|[A-Z]{{2}} \d{{5}}))?,? {_WORD}(?:[ -]{_WORD})?(?: [A-Z]{{2}})?(?: \d{{5}})?")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_INITIAL = re.compile(r"(?<!\w)[A-Z]\.(?:\s?[A-Z]\.)?")
_FUNCTION = frozenset(w for words in WORDS.values() for w in words.split())
_STOP_CONTEXT = re.compile(r"[A-Za-zÀ-ÿ]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Check digits of an international bank account number."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def number_features(s: str) -> list[str]:
    """What the digits of a span are like: length, grouping, check digits."""
    d = re.sub(r"\D", "", s)
    bare = re.sub(r"[\s.\-/()]", "", s)
    groups = "-".join(str(len(g)) for g in re.findall(r"\w+", s))
    out = [f"n={min(len(d), 20)}", f"g={groups}", "plus" if s.lstrip("(").startswith("+") else "noplus"]
    if re.match(r"(?:00|\+)\d", bare):
        out.append("country")
    if bare.startswith("0"):
        out.append("zero")
    if s.startswith("("):
        out.append("area")
    if re.fullmatch(r"\d{3}[-. ]\d{2}[-. ]\d{4}", s):
        out.append("social")
    if 13 <= len(d) <= 19 and d == bare and luhn(d):
        out.append("luhn")
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", bare):
        out.append("iban" if mod97(bare) else "iban-like")
    if re.fullmatch(r"[12789]\d{12}\d{0,2}", bare) and (len(bare) == 13 or (len(bare) == 15 and 97 - int(bare[:13]) % 97 == int(bare[13:]))):
        out.append("insee")
    if re.fullmatch(r"[A-Z]{1,2}\d{6,8}[A-Z]?", bare):
        out.append("passport")
    if re.search(r"[A-Z]", bare):
        out.append("letters")
    if re.match(r"(?:19|20)\d\d[.\-/ ]\d\d?[.\-/ ]\d\d?", s):
        out.append("date")
    if "/" in s:
        out.append("slash")
    return out


def shape(w: str) -> str:
    return "U" if w.isupper() and len(w) > 1 else "C" if w[:1].isupper() else "l"


class Segmenter:
    """Candidate segments of a text with features. `given` and `family` are known name parts, lower-cased."""

    def __init__(self, given: frozenset[str], family: frozenset[str]):
        self.given, self.family = given, family
        self.known = given | family

    def context(self, text: str, a: int, b: int) -> list[str]:
        before, after = text[max(0, a - 40) : a], text[b : b + 30]
        left, right = _STOP_CONTEXT.findall(before.lower())[-2:], _STOP_CONTEXT.findall(after.lower())[:2]
        return [f"l1={left[-1] if left else ''}", f"l2={'_'.join(left)}", f"r1={right[0] if right else ''}", f"lc={before.rstrip()[-1:]}", f"rc={after.lstrip()[:1]}", f"r={'_'.join(right)}"]

    def candidates(self, text: str) -> list[tuple[int, int, str, list[str]]]:
        """(start, end, kind, features), by end; a span may be a candidate for several kinds."""
        out = []
        for m in _EMAIL.finditer(text):
            a, b = m.span()
            s = m.group().rstrip(".-")
            b = a + len(s)
            domain = re.split(r"@|at[\])]", s)[-1]
            f = ["bias", "dot" if re.search(r"\.|dot", domain) else "nodot", "spelled" if re.search(r"[\[(]", s) else "sign"]
            out.append((a, b, "EMAIL", f))
        for m in _NUMBER.finditer(text):
            a, b = m.span()
            s = m.group().rstrip(" .-/(")
            if s.count("(") != s.count(")"):
                s = s.lstrip("(") if s.startswith("(") else s.split("(")[0].rstrip(" .-")
                a = m.start() + (m.group().find(s))
            b = a + len(s)
            f = number_features(s) + self.context(text, a, b)
            out += [(a, b, "PHONE", ["bias", *f]), (a, b, "ID_NUMBER", ["bias", *f])]
        for m in _ADDRESS.finditer(text):
            a, b = m.span()
            f = ["bias", *self.context(text, a, b), "number" if re.search(r"\d", m.group()) else "nonumber"]
            out.append((a, b, "ADDRESS", f))
            town = _TOWN.match(text, b)
            if town:
                out.append((a, town.end(), "ADDRESS", [*f, "town"]))
        out += self.names(text)
        out.sort(key=lambda x: (x[1], x[0]))
        return out

    def names(self, text: str) -> list[tuple[int, int, str, list[str]]]:
        """Pairs of words with a known part, pairs of capitalised words, and initials with a capitalised word; a middle initial may stand between and a family part may be doubled by a hyphen."""
        words = [(m.start(), m.end(), m.group()) for m in _NAME_WORD.finditer(text)]
        tag = []
        for _, _, w in words:
            low = w.lower()
            parts = low.split("-")
            g = low in self.given
            fam = any(p in self.family for p in parts)
            tag.append(("g" if g else "") + ("f" if fam else ""))
        out = []
        for i, (a, b, w) in enumerate(words):
            for j in (i + 1, i + 2):
                if j >= len(words):
                    break
                c, d, v = words[j]
                if j == i + 2 and not (len(words[i + 1][2]) == 1 and text[words[i + 1][1] : words[i + 1][1] + 1] == "." and text[b : words[i + 1][0]] in ((". ", ".", " ") if len(w) == 1 else (" ",))):
                    continue
                if not (tag[i] or tag[j]) and not (w[0].isupper() and v[0].isupper()):
                    continue
                gap = text[b:c]
                plain, comma, dot = gap in (" ", "  ", "\n") and j == i + 1, gap == ", ", j == i + 2 or (len(w) == 1 and gap in (". ", ".", " "))
                if not (plain or comma or dot):
                    continue
                if text[a - 1 : a] in ("@", ".", "-", "_", "+", "/") or text[d : d + 1] in ("@", "_", "/"):
                    continue
                if len(v) == 1 and not text[d : d + 1] == ".":
                    continue
                end = d + 1 if len(v) == 1 else d
                out.append(self.name(text, a, end, w, v, tag[i], tag[j], "comma" if comma else "dot" if dot else "plain"))
        return out

    def name(self, text: str, a: int, b: int, w: str, v: str, t: str, u: str, gap: str) -> tuple[int, int, str, list[str]]:
        one = "init" if len(w) == 1 else t or "?"
        two = "init" if len(v) == 1 else u or "?"
        shapes = shape(w) + shape(v)
        f = ["bias", f"tags={one}|{two}", f"tags={one}|{two}|{gap}", f"gap={gap}", f"shape={shapes}", f"ts={one}|{two}|{shapes}", "hyphen" if "-" in v or "-" in w else "single"]
        low = w.lower(), v.lower()
        if not (t and u):
            f += [f"w={low[0]}", f"v={low[1]}", f"{'function' if low[0] in _FUNCTION or low[1] in _FUNCTION else 'content'}|{shapes}"]
        around = self.context(text, a, b)
        if not (t or u):
            f += ["unlisted", f"unlisted|{shapes}|{gap}"]
            f += [f"unlisted|{gap}|{x}" for x in around]
        f += [f"{x}|{one}|{two}" for x in around[:3]] + around
        nxt = _NAME_WORD.match(text, b + 1) if text[b : b + 1] == " " else None
        f.append("next=" + (shape(nxt.group()) if nxt else "none"))
        return (a, b, "NAME", f)


class Model:
    """Weights of features by kind; a segment's score is their sum."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {k: {} for k in KINDS}

    def score(self, kind: str, features: list[str]) -> float:
        own = self.w[kind]
        return sum([own[f] for f in features if f in own])

    def decode(self, cands: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str]]:
        """The best disjoint segments: best[i] is the best score of the text up to the end of candidate i."""
        scored = [(a, b, k, s) for a, b, k, f in cands if (s := self.score(k, f)) > 0]
        ends, best, back = [0], [0.0], [None]
        for a, b, k, s in scored:
            lo = bisect.bisect_right(ends, a) - 1  # ends ascend
            value = best[lo] + s
            if value > best[-1]:
                ends.append(b)
                best.append(value)
                back.append((lo, (a, b, k)))
            else:
                ends.append(b)
                best.append(best[-1])
                back.append((len(best) - 2, None))
        out, i = [], len(ends) - 1
        while i > 0:
            lo, seg = back[i]
            if seg:
                out.append(seg)
            i = lo
        return out[::-1]

    def marginals(self, cands: list[tuple[int, int, str, list[str]]]) -> list[float]:
        """The probability of each segment, by sums over all sets of disjoint segments from both ends."""
        n = len(cands)
        s = [max(-30.0, min(30.0, self.score(k, f))) for _, _, k, f in cands]
        prev = []
        for a, _, _, _ in cands:
            prev.append(sum(1 for j in range(n) if cands[j][1] <= a))
        alpha = [0.0] * (n + 1)
        for i in range(n):
            x, y = alpha[i], alpha[prev[i]] + s[i]
            alpha[i + 1] = max(x, y) + math.log1p(math.exp(-abs(x - y)))
        # By derivative: the adjoint of alpha[n] with respect to each s.
        adj = [0.0] * (n + 1)
        adj[n] = 1.0
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            g = adj[i + 1]
            if g:
                p = math.exp(alpha[prev[i]] + s[i] - alpha[i + 1])
                out[i] = g * p
                adj[prev[i]] += g * p
                adj[i] += g * (1 - p)
        return out

    def train(self, texts: list[tuple[list[tuple[int, int, str, list[str]]], set[tuple[int, int, str]]]], passes: int, rng: random.Random) -> None:
        """Adagrad on the conditional log-likelihood."""
        norm: dict[str, dict[str, float]] = {k: {} for k in KINDS}
        for _ in range(passes):
            rng.shuffle(texts)
            for cands, gold in texts:
                for (a, b, k, f), p in zip(cands, self.marginals(cands), strict=True):
                    g = float((a, b, k) in gold) - p
                    if abs(g) < 1e-4:
                        continue
                    seen, own = norm[k], self.w[k]
                    for x in f:
                        seen[x] = seen.get(x, 1e-2) + g * g
                        own[x] = own.get(x, 0.0) + 0.25 * g / math.sqrt(seen[x])


def training_texts(given: list[str], family: list[str], count: int, rng: random.Random) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Labelled texts from templates: {KIND} slots are filled with made-up items, {x} slots with what only looks like one."""

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def coined() -> str:
        return "".join(rng.choice(("br", "cl", "dr", "f", "g", "k", "l", "m", "n", "p", "qu", "r", "s", "sk", "t", "th", "tr", "v", "w", "z")) + rng.choice(("a", "ae", "e", "ei", "i", "io", "o", "ou", "u", "y")) + rng.choice(("", "n", "r", "lt", "st", "x", "ck", "nd")) for _ in range(rng.choice((2, 2, 3)))).capitalize()

    def part(pool: list[str]) -> str:
        return coined() if rng.random() < 0.3 else rng.choice(pool)

    def name() -> str:
        g, f = part(given), part(family)
        if rng.random() < 0.25:
            f += "-" + part(family)
        kind = rng.random()
        s = f"{g} {f}" if kind < 0.7 else f"{f}, {g}" if kind < 0.85 else f"{g[0]}. {f}" if kind < 0.93 else f"{g} {rng.choice('ABCDEFGHKLMNPRSTVW')}. {f}"
        case = rng.random()
        return s.upper() if case < 0.1 else s.lower() if case < 0.16 and kind < 0.7 else s

    def mail() -> str:
        s = f"{rng.choice(given).lower()}{rng.choice(('.', '-', '_', '+', '9', ''))}{rng.choice(family).lower()}"
        host = rng.choice(("example.com", "example.org", "mail.example.net", f"{coined().lower()}.test", f"post.{coined().lower()}.invalid"))
        if rng.random() < 0.15:
            return f"{s} [at] {host.replace('.', ' [dot] ')}"
        return (s + "@" + host).upper() if rng.random() < 0.06 else s + "@" + host

    def phone() -> str:
        a, b = digits(3), digits(4)
        a = rng.choice("23456789") + a[1:]
        line = "01" + digits(2)
        return rng.choice((f"+1 {a} 555 {line}", f"({a}) 555-{line}", f"{a}-555-{line}", f"{a}.555.{line}", f"+1{a}555{line}", f"+44 20 7946 0{digits(3)}", f"020 7946 0{digits(3)}", f"(030) 23125 {digits(3)}", f"+49 30 23125{digits(3)}", f"030 23125{digits(3)}", f"01 99 00 {digits(2)} {digits(2)}", f"01.99.00.{digits(2)}.{digits(2)}", f"0199 00{b}", f"+33 1 99 00 {digits(2)} {digits(2)}", f"910 00 {digits(2)} {digits(2)}", f"910.00.{digits(2)}.{digits(2)}", f"+34 910 00 {digits(2)} {digits(2)}", f"0034 91000{b}", f"+34 91000{b}"))

    def number() -> str:
        def card() -> str:
            d = "99" + digits(13)
            d += next(c for c in "0123456789" if luhn(d + c))
            return rng.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))))

        def iban() -> str:
            body = "".join(rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if i < 4 and rng.random() < 0.7 else rng.choice("0123456789") for i in range(rng.choice((14, 16, 18, 20))))
            check = 98 - int("".join(str(int(c, 36)) for c in body + "XQ00")) % 97
            s = f"XQ{check:02d}{body}"
            return rng.choice((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))

        def insee() -> str:
            d = f"9{digits(2)}{rng.randint(1, 12):02d}99{digits(6)}"
            d += f"{97 - int(d) % 97:02d}"
            return rng.choice((d, f"{d[0]} {d[1:3]} {d[3:5]} {d[5:7]} {d[7:10]} {d[10:13]} {d[13:]}"))

        return rng.choice((lambda: f"9{digits(2)}-{digits(2)}-{digits(4)}", card, iban, insee, lambda: f"QX{digits(7)}"))()

    def street() -> str:
        n, c, t = str(rng.randint(1, 320)) + rng.choice(("", "", "", "A", "B")), part(family), coined()
        s = rng.choice((f"{n} {c} {rng.choice(STREETS_AFTER.split('|')[:10])}{rng.choice(('', '.'))}", f"{n}, rue de {c}", f"{n} rue {c}", f"{n} avenue {c}", f"Calle {c} {n}", f"Calle de {c}, {n}", f"Avenida de {c} {n}", f"{c}straße {n}", f"{c}weg {n}", f"{c}gasse {n}"))
        return s + rng.choice(("", "", f", {t}", f", {digits(5)} {t}"))

    fill = {"NAME": name, "EMAIL": mail, "PHONE": phone, "ID_NUMBER": number, "ADDRESS": street}
    small = sorted(_FUNCTION)
    nouns = ("Adapter", "Antrag", "Bestellung", "Dienst", "Index", "Kopie", "Konnektor", "Kunde", "Modul", "Partition", "Projekt", "Prüfung", "Rechnung", "Standort", "Tarif", "Team", "Version", "Vertrag")
    heads = ("Access", "Audit", "Data", "Head", "Index", "Monthly", "Notes", "Open", "Platform", "Quarterly", "Query", "Release", "Report", "Review", "Support", "Team", "VP", "Weekly")

    def compound() -> str:
        return rng.choice((rng.choice(nouns), rng.choice(nouns) + rng.choice(nouns).lower(), coined() + rng.choice(nouns).lower()))

    fakes = {
        "word": coined,
        "opener": lambda: f"{rng.choice(small).capitalize()} {coined()}",
        "noun": lambda: f"{compound()} {coined() if rng.random() < 0.6 else rng.choice(given + family + list(heads))}",
        "plain": lambda: " ".join(rng.choice((coined().lower(), rng.choice(small), rng.choice(given + family).lower())) for _ in range(4)),
        "german": lambda: f"{rng.choice(('Auf', 'Bei', 'Das', 'Der', 'Die', 'Für', 'Im', 'Jede', 'Seit', 'Unser', 'Unter'))} {rng.choice(nouns)}",
        "title": lambda: " ".join(rng.choice(heads) for _ in range(rng.choice((1, 2, 3)))),
        "caps": lambda: " ".join(rng.choice((coined(), rng.choice(heads), rng.choice(small))).upper() for _ in range(rng.choice((3, 5, 7)))),
        "product": lambda: f"{rng.choice(given + family)} {rng.choice(('Harbor', 'Court', 'Suite', 'Cloud', 'Console', 'Engine', 'Bridge', 'Release', 'Pilot'))}",
        "twin": lambda: f"{rng.choice(family)} {rng.choice(('adapter', 'account', 'gateway', 'template', 'office', 'site', 'queue', 'team'))}",
        "build": lambda: f"20{digits(2)}.{rng.randint(1, 12):02d}.{rng.randint(1, 28):02d}.{digits(4)}",
        "ticket": lambda: digits(8),
        "count": lambda: digits(7),
        "range": lambda: f"{digits(3)}-{digits(4)}",
        "stamp": lambda: f"20{digits(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{digits(2)}:{digits(2)}",
        "host": lambda: f"{coined().lower()}@build{digits(2)}",
        "bad": lambda: next(d for d in iter(lambda: "99" + digits(14), None) if not luhn(d)),
        "order": lambda: f"{digits(4)} {digits(4)}",
        "offset": lambda: digits(9),
        "trace": lambda: digits(rng.choice((12, 16))),
        "version": lambda: f"{digits(3)}.{digits(3)}",
    }
    said = [
        "Thanks to {NAME} for the patch (reach out via {EMAIL}).", "Escalations for this queue go to {NAME}, reachable at {EMAIL} or {PHONE}.", "Our field tech, {NAME}, asked to be paged on {PHONE}.",
        "Merci à {NAME} pour le correctif, voir {EMAIL}.", "Dank an {NAME} für die Korrektur, siehe {EMAIL}.", "Gracias a {NAME} por el arreglo, véase {EMAIL}.", "Les escalades vont à {NAME}, joignable à {EMAIL} ou au {PHONE}.",
        "Eskalationen gehen an {NAME}, erreichbar unter {EMAIL} oder {PHONE}.", "Las escaladas van a {NAME}, localizable en {EMAIL} o {PHONE}.", "Signed, {NAME}.", "Gezeichnet, {NAME}.", "Signé, {NAME}.", "Firmado, {NAME}.",
        "Mail bounced for {EMAIL}, so {NAME} rang {PHONE} instead.", "The reporter ({NAME}, {EMAIL}) still lives at {ADDRESS}.", "Forwarded by {NAME}, {EMAIL}.", "Owner row: {NAME};{EMAIL};{PHONE}", "Name: {NAME}; mail: {EMAIL}; mobile: {PHONE}; ref: {ID_NUMBER}",
        "Contact: {NAME} | {EMAIL} | {PHONE}", '{"owner": "{NAME}", "mail": "{EMAIL}"}', "Payment reached account {ID_NUMBER} last week.", "Card {ID_NUMBER} was charged twice.", "{NAME} confirmed the refund against {ID_NUMBER}.",
        "The claim was filed under {ID_NUMBER} by {NAME}.", "ID on record: {ID_NUMBER}, phone on record: {PHONE}.", "La demande porte le numéro {ID_NUMBER}.", "La solicitud lleva el número {ID_NUMBER}.", "Der Antrag trägt die Nummer {ID_NUMBER}.", "El pago llegó a {ID_NUMBER}.", "Virement reçu sur {ID_NUMBER}.",
        "Le passeport de {NAME} ({ID_NUMBER}) a expiré.", "El pase de {NAME} ({ID_NUMBER}) ha caducado.", "Der Ausweis von {NAME} ({ID_NUMBER}) ist abgelaufen.", "Bitte vor Mittag {PHONE} anrufen.", "Llamar al {PHONE} antes del mediodía.", "Appeler le {PHONE} avant midi.", "Call {PHONE} before noon.",
        "Send the signed form to {EMAIL} before the audit.", "Das Formular geht an {EMAIL}.", "Envoyer le formulaire signé à {EMAIL}.", "Ship replacement hardware to {ADDRESS}.", "Das Gerät geht an {ADDRESS}.", "Livrer le matériel au {ADDRESS}.", "Enviar el equipo a {ADDRESS}.", "{NAME} checked in under passport {ID_NUMBER}.", "Before noon {NAME} will move out of {ADDRESS}.",
        "Our records list {NAME} under passport {ID_NUMBER}.", "Interview notes: {NAME} moved from {ADDRESS} in spring.", "The lease at {ADDRESS} ends when {NAME} and {NAME} move out.", "Ersatzgeräte bitte an {ADDRESS} zu Händen von {NAME}.", "Contacto: {NAME}, {ADDRESS}.", "Contact : {NAME}, {ADDRESS}.", "Ansprechperson: {NAME}, {ADDRESS}.",
        "Invoices still go to {ADDRESS}.", "La factura sigue llegando a {ADDRESS}.", "La facture part toujours au {ADDRESS}.", "Best regards,\n{NAME}\n{PHONE}", "Cordialement,\n{NAME}\n{PHONE}", "It was {NAME} who found the leak, not {product}.", "Mme {NAME} a confirmé le remboursement.", "Dr. {NAME} confirmed the refund.", "Frau {NAME} hat die Erstattung bestätigt.", "La doctora {NAME} confirmó el reembolso.", "{NAME} et {NAME} ont relu le plan.", "Die Zahlung ging auf {ID_NUMBER} ein.", "Ship replacement hardware to {ADDRESS} and mark it for {NAME}.",
        "Ask {word} at {ADDRESS} when {NAME} is out.",
    ]
    empty = [
        "Build {build} passed on the second try.", "Price range {range} applies to seats 17-76.", "Mention @{word} in the thread if the counter passes {count}.", "Ask {word} on {host} for the shell log.", "Ticket {ticket} duplicates ticket {ticket}.", "{stamp} WARN the {word} table", "{product} is the code name of the {word} pilot.",
        "{word} and the VP Platform share offset {offset}.", "Trace {trace} was closed without action.", "Invoice {trace} covers {offset} rows.", "The {twin} archives the pending tickets.", "Order {bad} was returned.", "Since release {version} the {word} cache reads all edges into {word}.", "The {word} gateway keeps {order} rows.", "Version {version} of {word} replaces {twin}.", "The community summary for {word} reads the {twin}.", "Under load, {word} merges the {product} terms.", "The {product} release train leaves on Friday.", "A tenant admin at {word} counts 319 expense lines after 94 failed attempts.", "See also {word}, {word}", "Next: {word}",
        "{opener} gateway keeps the rows of {title}.", "{opener} is disabled, and {opener} environments stay on version {version}.", "{german} prüft {noun} vor dem Mittag, und {german} liest {noun}.", "{german} {word} erneuert den Plan, außer wenn {noun} wartet.", "{caps}\n{opener} service counts all rows.", "# {title}\n{opener} team skips a row.",
        "# {title} {word}\n{german} {word} liest.", "At the request of {word}, {word} caps every document.", "The questions mention {word}\n{opener} queue is empty.", "<b>{caps}</b> {german} sortiert die Zeilen.", "{caps}.", "{german} vergleicht den {noun} nach den {noun}, sofern {noun} am {noun} wartet.", "Fragen zu {word}, {plain}, und {plain} in {word}, {plain}.", "Für Umgebungen von {word} {word} prüft {german} den {noun}, auf Wunsch von {word} {word} auch mehr.",
        "À la demande de {word}, {word} plafonne le {title}.", "Para los entornos de {word}, {word} publica el plan de {word}.", "En el plan {title}, {word} cuenta; con {title}, {word} no.", "Avec le forfait {title}, {word} compte, et L'adaptateur {word} publie.", "A parcel for the {title} of {word} was returned.", "A. {opener} limit holds. B. {title} follows.",
    ]
    out = []
    slot = re.compile(r"\{(\w+)\}")
    for _ in range(count):
        text, gold = "", set()
        for template in [rng.choice(said if rng.random() < 0.6 else empty) for _ in range(rng.randint(1, 4))]:
            at = 0
            for m in slot.finditer(template):
                text += template[at : m.start()]
                kind = m.group(1)
                value = fill[kind]() if kind in fill else fakes[kind]()
                if kind in fill:
                    gold.add((len(text), len(text) + len(value), kind))
                text += value
                at = m.end()
            text += template[at:] + " "
        out.append((text, gold))
    return out


def trained(given: list[str], family: list[str], count: int = TRAINING_TEXTS, passes: int = PASSES, seed: int = SEED) -> tuple[Segmenter, Model]:
    """A model trained for these name parts; the same for the same arguments."""
    rng = random.Random(seed)
    given, family = sorted(given) or ["Alba"], sorted(family) or ["Torvik"]
    segmenter, model = Segmenter(frozenset(x.lower() for x in given), frozenset(x.lower() for x in family)), Model()
    model.train([(segmenter.candidates(t), g) for t, g in training_texts(given, family, count, rng)], passes, rng)
    return segmenter, model


def found_in(text: str, segmenter: Segmenter, model: Model) -> list[tuple[int, int, str]]:
    return model.decode(segmenter.candidates(text))


def name_parts(parts: DataFrame, most: int = 1_000_000) -> tuple[list[str], list[str]]:
    """All given and family name parts of parts(name_part, part_kind), in order.

    They are a reference list that goes to every executor; one of more than `most` rows is refused rather than cut.
    """
    some = parts.where("name_part is not null").select("name_part", "part_kind").distinct()
    if (n := some.count()) > most:
        raise ValueError(f"{n} name parts")
    rows = some.orderBy("part_kind", "name_part").collect()
    return [r.name_part for r in rows if r.part_kind == "given"], [r.name_part for r in rows if r.part_kind == "family"]


def find_personal_data(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(key, text) -> (key, items array<struct<start, end, kind>>, redacted) for every row.

    redacted has each item replaced by its kind in brackets. Null and empty texts have no items and stay as they are;
    repeated keys have a row each; an empty table gives none; no name parts means that few names are found.
    """
    shared = rows.sparkSession.sparkContext.broadcast(trained(*name_parts(parts)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter, model = shared.value
        for f in frames:
            items, redacted = [], []
            for text in f["text"]:
                found = found_in(text, segmenter, model) if text else []
                items.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                if text:
                    at, out = 0, []
                    for a, b, k in found:
                        out += [text[at:a], f"[{k}]"]
                        at = b
                    redacted.append("".join(out) + text[at:])
                else:
                    redacted.append(text)
            yield pd.DataFrame({"key": f["key"], "items": items, "redacted": redacted})

    return rows.select("key", "text").mapInPandas(run, "key string, items array<struct<start: bigint, end: bigint, kind: string>>, redacted string")


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = once(table(spark, folder, "chunks").select("chunk_id", "content", "created_at"), "chunk_id", F.desc_nulls_last("created_at"), F.col("content"))
    return rows.select(F.col("chunk_id").alias("key"), F.col("content").alias("text")), table(spark, folder, "name_parts")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items of personal data in the chunks' contents, each once for a re-delivered chunk."""
    found = find_personal_data(*_inputs(spark, folder)).select("key", F.explode("items").alias("item"))
    return found.select(F.col("key").alias("chunk_id"), F.col("item.kind").alias("pii_kind"), F.col("item.start").alias("start_pos"))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks' contents with typed placeholders."""
    return find_personal_data(*_inputs(spark, folder)).select(F.col("key").alias("chunk_id"), "redacted")


QUERIES = {"p7_found": p7_found, "p7_redacted": p7_redacted}
ORACLES: dict[str, str] = {}
