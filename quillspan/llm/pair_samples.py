"""Labelled question-answer pairs, composed to validate the cutoffs of the label model on."""

from __future__ import annotations

import random

#: (question, answer sentences) by language; {x} is a made-up name, {n} a number.
_SOUND = {
    "en": [
        ("How many replicas does {x} keep?", "{x} keeps {n} replicas. Two of them are in another region. The third one is only read at night."),
        ("Which port does the {x} service listen on?", "The {x} service listens on port {n}. It can be changed in the settings file of the host."),
        ("Why was the {x} index moved to another cluster?", "The old cluster had no room for the {x} index. After the move all queries are faster than before."),
        ("When does {x} expire?", "{x} expires after {n} days."),
        ("Who approves changes to {x}?", "Changes to {x} are approved by the owner of the account and by one more person from the team."),
    ],
    "de": [
        ("Wie viele Kopien hält {x}?", "{x} hält {n} Kopien. Zwei davon liegen in einer anderen Region. Die dritte wird nur in der Nacht gelesen."),
        ("Warum wurde der Index {x} verlegt?", "Am alten Standort war für den Index {x} kein Platz. Nach dem Umzug sind alle Abfragen schneller als zuvor."),
        ("Wann läuft {x} ab?", "{x} läuft nach {n} Tagen ab."),
        ("Wer gibt Änderungen an {x} frei?", "Änderungen an {x} werden von dem Besitzer des Kontos und einer weiteren Person aus dem Team freigegeben."),
    ],
    "fr": [
        ("Combien de copies {x} conserve-t-il ?", "{x} conserve {n} copies. Deux sont dans une autre région. La troisième n'est lue que pendant la nuit."),
        ("Pourquoi l'index {x} a-t-il été déplacé ?", "L'ancien site n'avait plus de place pour l'index {x}. Depuis, les requêtes sont plus rapides qu'avant."),
        ("Quand {x} expire-t-il ?", "{x} expire après {n} jours."),
        ("Qui valide les changements de {x} ?", "Les changements de {x} sont validés par le propriétaire du compte et par une autre personne de l'équipe."),
    ],
    "es": [
        ("¿Cuántas copias guarda {x}?", "{x} guarda {n} copias. Dos están en otra región. La tercera solo se lee por la noche."),
        ("¿Por qué se movió el índice {x}?", "En el sitio anterior no había espacio para el índice {x}. Desde entonces las consultas son más rápidas que antes."),
        ("¿Cuándo caduca {x}?", "{x} caduca después de {n} días."),
        ("¿Quién aprueba los cambios de {x}?", "Los cambios de {x} los aprueba el dueño de la cuenta y otra persona del equipo."),
    ],
}
_NOTHING = ["", " ", "-", "N/A", "n/a", "none", "TBD", "...", "?", "null", "k. A.", "s/o", "pendiente", "TODO"]
_REFUSED = {
    "en": ["I'm sorry, but I can't answer that.", "I cannot provide this information.", "As an AI language model, I am unable to say.", "Unfortunately I don't have enough information to answer the question.", "I would rather not comment on this.", "The context does not contain an answer."],
    "de": ["Das kann ich leider nicht beantworten.", "Dazu darf ich keine Auskunft geben.", "Es tut mir leid, dazu liegen mir keine Angaben vor.", "Als KI kann ich dazu nichts sagen."],
    "fr": ["Je suis désolé, je ne peux pas répondre à cette question.", "Je ne dispose pas de cette information.", "Malheureusement, il m'est impossible de le dire."],
    "es": ["Lo siento, no puedo responder a esa pregunta.", "No dispongo de esa información.", "Lamentablemente no me es posible decirlo."],
}
_POINTING = {
    "en": ["What does this passage say about the limit?", "According to the text, when does it expire?", "Why did they move it?", "Which of the options above is faster?", "What is the main point of the section?", "What was its limit?"],
    "de": ["Was sagt dieser Abschnitt über das Limit?", "Welche der oben genannten Optionen ist schneller?", "Warum haben sie es verlegt?"],
    "fr": ["Que dit ce passage sur la limite ?", "Laquelle des options ci-dessus est plus rapide ?"],
    "es": ["¿Qué dice este pasaje sobre el límite?", "¿Cuál de las opciones anteriores es más rápida?"],
}


def composed_pairs(count: int, rng: random.Random) -> list[tuple[str, str, str, str]]:
    """(question, answer, passage, defect): defect is "" for a sound pair; half of the pairs are sound, the rest share the defects."""

    def fill(text: str, x: str, n: str) -> str:
        return text.replace("{x}", x).replace("{n}", n)

    out = []
    for _ in range(count):
        lang = rng.choice(("en", "en", "de", "fr", "es"))
        x = "".join(rng.choice(("br", "d", "f", "k", "l", "m", "n", "p", "t", "v", "z")) + rng.choice("aeiou") + rng.choice(("", "n", "r", "st")) for _ in range(2)).capitalize()
        n = str(rng.randint(2, 90))
        q, a = (fill(t, x, n) for t in rng.choice(_SOUND[lang]))
        passage = rng.choice(("", "yes", "unknown"))
        defect = rng.choice(("", "", "", "", "", "", "empty", "truncated", "refusal", "echo", "language", "dependent"))
        if defect == "empty":
            a = rng.choice(_NOTHING)
        elif defect == "truncated":
            words = a.split()
            if len(words) < 10:
                defect = ""
            else:
                cut = rng.randint(max(8, len(words) // 2), len(words) - 2)
                a = " ".join(words[:cut])
                if a[-1] in ".!?":
                    a += " " + words[cut]
                if len(a.split()[-1]) > 4 and rng.random() < 0.6:
                    a = a[: -rng.randint(1, 3)]
        elif defect == "refusal":
            a = rng.choice(_REFUSED[lang])
        elif defect == "echo":
            a = rng.choice((q, q.upper(), q.rstrip("?¿ "), q.lower()))
        elif defect == "language":
            other = rng.choice([k for k in _SOUND if k != lang])
            a = fill(max((t[1] for t in rng.sample(_SOUND[other], 2)), key=len), x, n)
        elif defect == "dependent":
            q, passage = rng.choice(_POINTING[lang]), rng.choice(("yes", "unknown"))
        out.append((q, a, passage, defect))
    return out
