"""Problem 6: defective question-answer pairs by noisy labelling functions and an expectation-maximization label model.

Every defect has several labelling functions that vote for it (1), against it (0) or abstain (-1). The label model is
learned from the counts of vote patterns, which are few whatever the number of pairs, and gives each pattern a posterior
for each defect; a pair keeps every defect whose posterior exceeds the defect's cutoff, which is validated on composed pairs in each run.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.pair_samples import composed_pairs
from quillspan.plans.once import once
from quillspan.plans.spool import spool
from quillspan.sources.tables import table

DEFECTS = ("empty", "truncated", "refusal", "echo", "language", "dependent")
#: Posteriors above which a defect is kept: each defect has the one of these that does best on VALIDATION composed pairs.
CUTOFFS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
VALIDATION = 1_500
SEED = 31
#: Defects in the order in which one is named where only one may be.
PRECEDENCE = ("empty", "refusal", "echo", "language", "truncated", "dependent")

# Stand-ins for an answer, and function words by which languages are told.
PLACEHOLDERS = re.compile(
    r"(?i)^[\s\W]*(?:n\s*/?\s*a|none|null|nil|nan|tbd|tbc|todo|to do|to be (?:done|added|determined)|unknown|pending|placeholder|missing|empty|blank|no answer|none given|not available|not provided|answer here|your answer here|fixme|xxx+|\?+|sin respuesta|keine antwort|aucune réponse|pendiente|offen|à compléter|keine angabe|k\.?\s?a\.?|s/o|sans objet|lorem ipsum)?[\s\W]*$"
)
WORDS = {
    "en": "the a an of to and in is are was were it its for with on at by from not no yes as that this which be before after until because while than each every they them how what when where who why does do can has have keeps keep using under during only",
    "de": "der die das den dem des ein eine einen einem einer eines und ist sind wird werden nicht von zu im in mit auf für bei aus nach vor da weil dass als auch oder er sie es wie was wann wo wer warum welche welcher welches ab am an über unter zwischen während sofern jede jeder ohne zur zum",
    "fr": "le la les un une des du de et est sont pas ne que qui dans pour avec sur par au aux en ce cette il elle ils elles se sa son ses plus après avant comme mais ou où quand comment pourquoi quelle quel quels combien depuis pendant sans selon chaque donc sauf tandis puisque",
    "es": "el la los las un una unos de del y es son no que en para con por se su sus al lo como más pero cuando cuándo dónde cómo qué cuál cuánto desde hasta sin según cada entre antes después porque aunque mientras siempre solo tras así está están",
}
REFUSALS = [
    r"(?i)\bI(?:'|’)?(?:\s+a)?m\s+(?:sorry|afraid|unable|not\s+able|not\s+permitted|not\s+allowed)\b|\bI\s+(?:can(?:no|')?t|can\s+not|could\s+not|won't|will\s+not|must\s+decline|have\s+to\s+decline|do\s+not|don't|am\s+(?:unable|not))\b",
    r"(?i)\b(?:as\s+an?\s+(?:AI|assistant|language\s+model)|en\s+tant\s+qu['’]|como\s+(?:asistente|modelo)|als\s+(?:KI|assistent|sprachmodell))",
    r"(?i)\b(?:context|information|passage|documents?|excerpt|source|Kontext|Angaben|Informationen|contexte|contexto|información|informations?)\b[^.]{0,60}\b(?:does\s+not|doesn['’]t|do\s+not|don['’]t|not\s+(?:enough|sufficient)|reicht|nicht|ne\s+(?:permet|suffit|contient)|no\s+(?:me\s+)?(?:permite|basta|contiene|es\s+suficiente))",
    r"(?i)\b(?:outside|beyond)\s+what\s+I|\bunable\s+to\s+(?:determine|answer|provide|say)|\bcannot\s+(?:answer|help|provide|assist|say|share)\b|\bnot\s+able\s+to\s+(?:answer|provide|help)|\bsorry\s*[,.!;:]|\bsorry\s+but\b|\bapolog(?:i[sz]e|ies)\b|\bunfortunately\b|\bnothing\s+I\s+can\s+say\b|\bagainst\s+my\s+(?:guidelines|rules|policy)|\bnot\s+be\s+appropriate\b|^\W*no\s+comment\s*[.!]|\brather\s+not\b|\b(?:beyond|outside)\s+(?:of\s+)?my\s+scope\b|\bmust\s+decline\b|\bdecline\s+(?:to|this)\b",
    r"(?i)\b(?:kann|können|konnte|darf)\b[^.]{0,50}\b(?:leider|nicht|keine)\b|\bleider\b|\btut\s+mir\s+leid|\bnicht\s+(?:beantworten|sagen|weitergeben)\b|\bkeine\s+(?:auskunft|angaben|antwort|informationen|daten)\b|\bliegen\s+mir\s+keine\b|^\W*kein\s+kommentar\b|\bmöchte\s+ich\s+(?:mich\s+)?(?:nichts|nicht)\b",
    r"(?i)\b(?:désolée?|je\s+(?:ne\s+(?:peux|suis|dispose|sais)|regrette)|m['’]est\s+impossible|malheureusement|je\s+n['’]ai\s+pas|je\s+préfère(?:rais)?\s+ne|je\s+m['’]abstiens|(?:sans|aucun|pas\s+de)\s+commentaire)\b",
    r"(?i)\b(?:lo\s+siento|lamento|no\s+(?:puedo|(?:me\s+)?es\s+posible|tengo|dispongo|estoy|opinar|comentar)|(?:prefiero|mejor)\s+no|sin\s+comentarios|me\s+es\s+imposible|lamentablemente|desafortunadamente)\b",
]
_REFUSAL = [re.compile(p) for p in REFUSALS]
_FIRST = re.compile(r"(?i)\b(?:I|my|comment|comentarios?|kommentar|opinar|I'm|I’m|me|my|ich|mir|je|j['’]|m['’]|yo|puedo|tengo|siento|lamento|dispongo|estoy|context|passage|contexte|contexto|kontext|information|unfortunately|leider|malheureusement|lamentablemente|sorry)\b")
#: What needs the passage that a question was made from.
POINTERS = [
    r"(?i)\b(?:this|that|the)\s+(?:section|passage|excerpt|text|paragraph|document|article|chapter|page|author|table|figure|list|example)\b(?!\s+(?:field|table|of|column|record|store|hold|type|id|key|index))",
    r"(?i)\b(?:above(?!\s+\d)|below(?!\s+\d)|aforementioned|mentioned\s+(?:here|earlier|before)|previous\s+(?:section|paragraph|sentence)|following\s+(?:section|paragraph))\b|\b(?:the\s+two|these|those)\s+(?:options|steps|values|items|limits)\b",
    r"(?i)^\W*(?:why|when|where|how|what|who|which|did|does|do|is|was|can)\b[^?]{0,40}\b(?:they|it|he|she|them|these|those)\b",
    r"(?i)\baccording\s+to\s+(?:the|this)\s+(?:author|text|passage|document|excerpt|section)\b|\b(?:this|the\s+given)\s+(?:context|excerpt|passage)\b",
    r"(?i)\b(?:dieser?[mns]?|im|laut\s+dem)\s+(?:abschnitt|text|auszug|absatz|dokument|tabelle)\b|\b(?:oben|unten|obige[nrs]?|genannte[nrs]?)\b|\b(?:haben|hat)\s+(?:sie|er|es)\b",
    r"(?i)\b(?:cette|ce|cet|la|le|l['’])\s*(?:section|passage|extrait|texte|paragraphe|document|auteur|tableau)\b|\bci-(?:dessus|dessous)\b|\b(?:ont|a)-t?-?(?:ils|elles|il|elle)\b(?!.*[A-Z][a-z]{3,})",
    r"(?i)\b(?:esta|este|el|la|del)\s+(?:sección|pasaje|fragmento\s+anterior|extracto|texto|párrafo|documento|autora?|tabla)\b|\b(?:anterior(?:es)?|arriba|abajo|mencionad[oa]s?)\b",
]
POINTERS += [
    r"(?i)\bthe\s+(?:snippet|writer|speaker|narrator)\b|\b(?:first|second|third|last|next)\s+(?:paragraph|sentence)\b",
    r"(?i)^\W*(?:what|why|when|who|how|where|which)\s+(?:is|was|are|were)\s+(?:its|their|his|her|that|this|it|these|those)\b",
    r"(?i)\b(?:listed|shown|described|mentioned|given|stated|discussed)\s+(?:here|above|below|in\s+(?:the|this)\s+(?:text|passage|section|paragraph|table))\b",
]
_POINTERS = [re.compile(p) for p in POINTERS]
_TOKEN = re.compile(r"[^\W_]+")
_SETS = {k: frozenset(v.split()) for k, v in WORDS.items()}
_END = re.compile(r"[.!?…。][\"'’”»)\]]*\s*$")


def language_of(tokens: list[str], text: str) -> str:
    """The language whose function words and letters are most frequent; empty if none is ahead."""
    score = {k: sum(t in s for t in tokens) for k, s in _SETS.items()}
    score["de"] += 2 * len(re.findall(r"[äöüß]", text.lower()))
    score["es"] += 2 * len(re.findall(r"[ñ¿¡]|\b\w+ción\b", text.lower()))
    score["fr"] += 2 * len(re.findall(r"[êèàçœù]|\b[dlnsjmc]['’]", text.lower()))
    best, second = sorted(score.values(), reverse=True)[:2]
    return max(score, key=score.get) if best >= second + 2 or (best > second and second == 0) else ""


def votes(question: str, answer: str, passage: str) -> dict[str, list[int]]:
    """The labelling functions' votes on each defect. `passage`: yes, no or unknown, whether the pair was made to stand alone; "" where it can't depend on one."""
    q, a = question or "", answer or ""
    qt, at = _TOKEN.findall(q.lower()), _TOKEN.findall(a.lower())
    out: dict[str, list[int]] = {}
    blank = not a.strip()
    stand = bool(PLACEHOLDERS.match(a))
    out["empty"] = [int(blank) if blank or len(at) > 3 else -1, int(stand), 1 if not at else 0 if len(at) > 4 else -1]
    hits = [bool(p.search(a)) for p in _REFUSAL]
    person = bool(_FIRST.search(a))
    first_sentence = re.split(r"(?<=[.!?])\s", a.strip(), maxsplit=1)[0]
    early = any(p.search(first_sentence) for p in _REFUSAL)
    out["refusal"] = [int(any(hits)), int(early and person), 0 if re.search(r"\d", a) or not any(hits) else 1 if len(at) <= 25 else -1]
    # An echo adds nothing to the question's words.
    extra = [t for t in at if t not in set(qt)]
    said = sum(t in set(at) for t in qt) / max(1, len(qt))
    bare = lambda t: " ".join(t)
    same = bool(at) and bool(qt) and (bare(at) == bare(qt) or bare(at) == bare(qt + qt) or (bare(qt).startswith(bare(at)) and len(at) >= 4))
    out["echo"] = [int(same), 0 if not at or len(extra) > 2 else int(said >= 0.8), 1 if at and not extra and len(at) >= 4 else 0]
    lq, la = language_of(qt, q), language_of(at, a)
    clear = bool(lq and la) and len(at) >= 4
    own = sum(t in _SETS.get(lq, ()) for t in at)
    other = sum(t in _SETS.get(la, ()) for t in at)
    out["language"] = [int(lq != la) if clear else -1, (int(lq != la and other > 2 * own) if clear else 0), 0 if not clear or lq == la else 1 if other >= own + 3 else -1]
    if same is False and q and a.lower().startswith(q.rstrip("? ").lower()):
        a = a[len(q.rstrip("? ")) :].lstrip(" ?:\u00a0")  # an answer that repeats the question first is judged by the rest
    closed = bool(_END.search(a))
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", a.strip()) if x]
    tail = sentences[-1] if sentences else ""
    single = len(sentences) <= 1
    long_tail = len(tail.split()) >= 7
    torn = bool(re.search(r"(?:[,;:(]|\b(?:the|of|and|a|an|to|with|for|in|und|der|die|das|le|la|de|et|el|los|las|y|que|por|von))\s*$", a))
    ellipsis = bool(re.search(r"(?:\.{3}|…)\s*$", a))
    out["truncated"] = [0 if closed or not at else 1 if not single else -1, 0 if closed and not ellipsis else 1 if long_tail or torn else 0 if single else 1, 1 if at and not closed and (not single or len(a) > 60 or torn) else 0]
    if passage == "":
        out["dependent"] = [0, 0, 0]
    else:
        pointing = sum(bool(p.search(q)) for p in _POINTERS)
        # A question that stands alone names what it is about: a capitalised word after the first.
        names = bool(re.search(r"(?<=\s)[A-ZÄÖÜÉ][\wäöüßéèñó]{2,}", q))
        out["dependent"] = [int(pointing > 0), 1 if pointing else 0, -1 if names else int(not names)]
    return out


def label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Posterior of a defect for each vote pattern: expectation-maximization over the functions' accuracies and the prior.

    patterns: (votes of 1, 0 or -1, how many pairs). Starts from the majority of the votes; functions vote rightly more
    often than not in the prior counts, which also keeps an unvoted defect from being found.
    """
    if not patterns:
        return {}
    x = np.array([p for p, _ in patterns])
    w = np.array([c for _, c in patterns], float)
    g = np.where((x == 1).sum(1) > (x == 0).sum(1), 0.9, 0.05)
    for _ in range(rounds):
        prior = (w @ g + 0.5) / (w.sum() + 10.0)
        odds = np.full(len(x), np.log(prior / (1 - prior)))
        for f in range(x.shape[1]):
            for side, sign in ((g, 1.0), (1 - g, -1.0)):
                n = np.array([w @ (side * (x[:, f] == v)) for v in (-1, 0, 1)])
                n += np.array([0.5, 0.5, 4.0]) if sign > 0 else np.array([0.5, 4.0, 0.5])
                odds += sign * np.log(n / n.sum())[x[:, f] + 1]
        g = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    # No defect without a vote for it.
    g = np.where((x == 1).any(1), g, 0.0)
    return {tuple(int(v) for v in p): float(v) for p, v in zip(x, g, strict=True)}


def validated_cutoffs(posteriors: dict[str, dict[tuple[int, ...], float]], count: int = VALIDATION, seed: int = SEED) -> dict[str, tuple[float, float, float]]:
    """{defect: (cutoff, precision, recall)}: the cutoff of the highest F1 on composed pairs, of equal ones the nearest to 0.5.

    A vote pattern that the data doesn't have counts as that of the nearest one that it has, by differing votes.
    """
    labelled = [(votes(q, a, p), d) for q, a, p, d in composed_pairs(count, random.Random(seed))]
    out = {}
    for d, known in posteriors.items():
        if not known:
            continue
        scores = []
        for v, label in labelled:
            pattern = tuple(v[d])
            nearest = pattern if pattern in known else min(known, key=lambda k: (sum(x != y for x, y in zip(k, pattern, strict=True)), k))
            scores.append((known[nearest], label == d))
        best = None
        for cut in CUTOFFS:
            hit = sum(s >= cut and y for s, y in scores)
            said, true = sum(s >= cut for s, _ in scores), sum(y for _, y in scores)
            f1 = 2 * hit / max(1, said + true)
            if best is None or (round(f1, 4), -abs(cut - 0.5)) > best[0]:
                best = ((round(f1, 4), -abs(cut - 0.5)), (cut, hit / max(1, said), hit / max(1, true)))
        out[d] = best[1]
    return out


def defects(pairs: DataFrame, cutoff: float | None = None) -> DataFrame:
    """pairs(key, question, answer, answerable, passage) -> (key, defect, posterior), a row for each defect of each pair.

    answerable: false where no answer is right, so that an empty or refusing one is none of the defects; null counts as
    true. passage: "no" where the pair is marked as not standing alone, "yes" or "unknown" else, "" where that does not
    apply. Null questions and answers are empty texts; of repeated rows of a key the first by question and answer counts; rows without a key are left
    out; an empty table gives none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = [votes(q, a, p) for q, a, p in zip(f["question"], f["answer"], f["passage"], strict=True)]
            yield pd.DataFrame({"key": f["key"], "answerable": f["answerable"], "passage": f["passage"], **{d: [x[d] for x in v] for d in DEFECTS}})

    clean = once(pairs, "key", F.col("question"), F.col("answer")).select("key", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("answerable", F.lit(True)).alias("answerable"), F.coalesce("passage", F.lit("")).alias("passage"))
    voted = spool(clean.mapInPandas(run, "key string, answerable boolean, passage string, " + ", ".join(f"{d} array<int>" for d in DEFECTS)))
    long = voted.select("key", "answerable", "passage", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS])).alias("x")).select("key", "answerable", "passage", "x.*")
    counts = long.groupBy("defect", "votes").count().collect()  # at most 6 * 27 rows
    learned = {d: label_model([(tuple(r.votes), r["count"]) for r in counts if r.defect == d]) for d in DEFECTS}
    if not any(learned.values()):
        return long.select("key", "defect", F.lit(0.0).alias("posterior")).limit(0)
    cut = {d: c for d, (c, _, _) in validated_cutoffs(learned).items()} if cutoff is None else dict.fromkeys(DEFECTS, cutoff)
    posteriors = [(d, list(p), g) for d, by in learned.items() for p, g in by.items() if g >= cut[d]]
    known = pairs.sparkSession.createDataFrame(posteriors, "defect string, votes array<int>, posterior double")
    found = long.join(F.broadcast(known), ["defect", "votes"])  # at most 6 * 27 rows
    found = found.where(F.col("answerable") | ~F.col("defect").isin("empty", "refusal")).where((F.col("defect") != "dependent") | (F.col("passage") != "no"))
    return found.select("key", "defect", "posterior")


def single_defect(found: DataFrame) -> DataFrame:
    """(key, defect): of several defects of a pair the one that comes first in PRECEDENCE."""
    order = F.array_position(F.array(*[F.lit(d) for d in PRECEDENCE]), F.col("defect"))
    return found.groupBy("key").agg(F.min_by("defect", order).alias("defect"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    cases = once(table(spark, folder, "eval_cases"), "id", F.desc_nulls_last("created_at"), F.col("question"), F.col("expected_answer")).select(F.col("id").alias("key"), "question", F.col("expected_answer").alias("answer"), F.coalesce(F.lower(F.try_element_at("metadata", F.lit("answerable"))) != "false", F.lit(True)).alias("answerable"), F.lit("").alias("passage"))
    stands = F.when(F.col("self_contained"), "yes").when(~F.col("self_contained"), "no").otherwise("unknown")
    made = once(table(spark, folder, "generated_questions"), "gq_id", F.desc_nulls_last("created_at"), F.col("question"), F.col("answer")).select(F.col("gq_id").alias("key"), "question", "answer", F.coalesce("answerable", F.lit(True)).alias("answerable"), stands.alias("passage"))
    return cases.unionByName(made)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of eval_cases and generated_questions with their defect."""
    return single_defect(defects(_pairs(spark, folder))).withColumnRenamed("key", "item_id")


def p6_posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect of every pair with its posterior."""
    return defects(_pairs(spark, folder)).select(F.col("key").alias("item_id"), "defect", F.round("posterior", 6).alias("posterior"))


QUERIES = {"p6_found": p6_found, "p6_posteriors": p6_posteriors}
ORACLES: dict[str, str] = {}
