"""Problem 4: markup left in texts, by a linear-chain conditional random field over leaf blocks.

A text is broken into leaf blocks: tags, entities, code samples, formulas, marks and lines of plain text, each with the
tags and environments that are open around it. The chain labels every block with the markup that it belongs to (or as
plain text or code); weights are trained on labelled pages that `labelled_pages` composes, by stochastic gradients of the
conditional likelihood with forward-backward sums, and texts are decoded by Viterbi. Clean text is put together from the
labelled blocks: headings, lists, code and formulas are kept as structure.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.plans.once import once
from quillspan.sources.tables import table

LABELS = ("plain", "code", "html", "markdown", "wiki", "latex")
MARKUPS = LABELS[2:]
PAGES = 700
PASSES = 5
SEED = 11

#: Leaf blocks by what they look like; the first that matches at a place is taken. What they mean is the chain's to say.
_LEAVES = [
    ("fence", r"(?ms)^[ \t]*(```|~~~)[^\n`]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)"),
    ("pre", r"(?is)<pre\b[^>]*>.*?(?:</pre\s*>|\Z)"),
    ("codetag", r"(?is)<code\b[^>]*>.*?</code\s*>"),
    ("source", r"(?is)<(syntaxhighlight|source|nowiki)\b[^>]*>.*?(?:</\2\s*>|\Z)"),
    ("verbatim", r"(?s)\\begin\{(verbatim|lstlisting|minted)\}.*?(?:\\end\{\3\}|\Z)"),
    ("verb", r"\\verb([|!+/])[^\n]*?\4"),
    ("environment", r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
    ("display", r"(?s)\$\$(?:(?!\n[ \t]*\n)[^$])+\$\$|\\\[(?:(?!\n[ \t]*\n).)+?\\\]"),
    ("math", r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?!\d)|\\\([^\n]+?\\\)"),
    ("command", r"~?\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})+"),
    ("bare", r"\\(?:item|hline|centering|par|noindent|newline|maketitle|LaTeX|TeX|ldots|quad|alpha|beta|gamma|delta|lambda|sigma|sum|frac|le|ge|cdot|times|\\)\b|\\[%&#_$](?![A-Za-z])"),
    ("comment", r"(?s)<!--.*?(?:-->|\Z)"),
    ("tag", r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z_:][\w:.\-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>"),
    ("tornTag", r"</?(?:p|div|span|br|li|ul|ol|td|tr|th|table|h[1-6]|em|strong|b|i|a|code|pre)\b[^<>\n]*$"),
    ("entity", r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,10});"),
    ("wikitable", r"(?m)^\{\|[^\n]*|^\|\}|^\|-[^\n]*|^\|\+[^\n]*|^![^\n!]+(?:!![^\n]*)?$|^\|[^\n|]+\|\|[^\n]*"),
    ("wikilink", r"\[\[[^\[\]\n]+\]\]"),
    ("template", r"\{\{[^{}\n]+\}\}"),
    ("wikiheading", r"(?m)^\s*={2,6}[^=\n]+={2,6}[ \t]*$"),
    ("quotes", r"'''''[^'\n]+'''''|'''[^'\n]+'''|(?<!')''(?!')[^'\n]+''(?!')"),
    ("external", r"\[(?:https?:|mailto:)\S+[^\]\n]*\](?!\()"),
    ("image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("link", r"\[[^\]\n]+\]\([^)\s]+(?:\s+\"[^\"\n]*\")?\)"),
    ("reflink", r"\[[^\]\n]+\]\[[^\]\n]*\]|(?m:^\[[^\]\n]+\]:\s+\S+.*$)"),
    ("inlinecode", r"(`+)(?=[^`])[^\n]*?[^`]\5(?!`)"),
    ("strong", r"(?<![\w*])\*\*(?=[^\s*])[^*\n]*?[^\s*]\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^_\n]*?[^\s_]__(?![\w_])"),
    ("emph", r"(?<![\w*])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![\w*])|(?<![\w_/.])_(?=[^\s_])[^_\n]*?[^\s_]_(?![\w_])"),
    ("strike", r"~~(?=\S)[^~\n]+~~"),
    ("mdheading", r"(?m)^#{1,6}[ \t]+[^\n]+$"),
    ("mdrule", r"(?m)^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"),
    ("mdrow", r"(?m)^\|[^\n]+\|[ \t]*$"),
    ("task", r"(?m)^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"),
    ("ones", r"(?m)^1\.[ \t](?=[^\n]*\n1\.[ \t])|(?<=\n)1\.[ \t]"),
    ("bullet", r"(?m)^[ \t]*[-*+][ \t]+(?=\S)"),
    ("wikibullet", r"(?m)^[*#:;]+(?=[^\s*#=])"),
    ("number", r"(?m)^[ \t]*\d{1,3}\.[ \t]+(?=\S)"),
    ("quote", r"(?m)^>[ \t]+"),
    ("single", r"(?<=\w)~(?=\\)"),
    ("odd", r"[{}]|<|&|\$|`|\*|~|\\"),
]
_WORDS = re.compile(r"[^\W\d_]+")


def _compiled() -> list[tuple[str, re.Pattern[str]]]:
    return [(n, re.compile(re.sub(r"\\([2-5])(?=[^\d]|$)", r"\\1", p))) for n, p in _LEAVES]


_PATTERNS = _compiled()
_ANY = re.compile(r"[<&\\$`*_~\[\]{}|=#'>!\n+\-:;\d]")


class Leaf:
    __slots__ = ("end", "kind", "open", "start", "text")

    def __init__(self, kind: str, start: int, end: int, text: str, around: str):
        self.kind, self.start, self.end, self.text, self.open = kind, start, end, text, around


def leaves(text: str) -> list[Leaf]:
    """The leaf blocks that aren't plain prose, in order, and one leaf for each stretch of prose between them."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            if m.end() > m.start():
                taken.append((m.start(), m.end(), kind))
    rank = {k: i for i, (k, _) in enumerate(_LEAVES)}
    inside = {"fence", "pre", "source", "verbatim", "codetag", "inlinecode", "verb", "comment", "display", "math"}
    # Code and formulas swallow what lies in them; otherwise the earlier kind of two that overlap is kept.
    taken.sort(key=lambda t: (t[2] not in inside, rank[t[2]], t[0]))
    used = np.zeros(len(text) + 1, dtype=bool)
    kept = []
    for a, b, kind in taken:
        if kind == "bullet" and kept and used[a:b].any():
            continue
        if not used[a:b].any():
            used[a:b] = True
            kept.append((a, b, kind))
    kept.sort()
    out: list[Leaf] = []
    at, stack = 0, []
    for a, b, kind in [*kept, (len(text), len(text), "")]:
        if a > at and text[at:a].strip():
            out.append(Leaf("prose", at, a, text[at:a], stack[-1] if stack else ""))
        if not kind:
            break
        s = text[a:b]
        if kind in ("tag", "environment"):
            name = re.search(r"[A-Za-z]+[0-9]?", s.replace("\\begin", "").replace("\\end", ""))
            tag = name.group().lower() if name else ""
            if s.startswith("</") or s.startswith("\\end"):
                if stack:
                    stack.pop()
            elif not s.endswith("/>") and tag not in ("br", "hr", "img", "meta", "link", "input"):
                stack.append(tag)
        out.append(Leaf(kind, a, b, s, stack[-1] if stack else ""))
        at = b
    return out


def page_features(items: list[Leaf]) -> set[str]:
    """Kinds that the page has at all, by family: evidence for what its ambiguous blocks are."""
    family = {"tag": "H", "entity": "H", "pre": "H", "link": "M", "reflink": "M", "fence": "M", "mdheading": "M", "mdrule": "M", "task": "M", "strong": "M", "strike": "M", "image": "M", "wikilink": "W", "template": "W", "wikiheading": "W", "quotes": "W", "wikitable": "W", "environment": "L", "command": "L", "display": "L", "verbatim": "L", "math": "L"}
    return {family[x.kind] for x in items if x.kind in family}


def features(items: list[Leaf], text: str, title: bool) -> list[list[str]]:
    page = sorted(page_features(items))
    out = []
    for i, x in enumerate(items):
        line_start = text.rfind("\n", 0, x.start) + 1
        line_end = text.find("\n", x.end)
        line = text[line_start : line_end if line_end >= 0 else len(text)]
        f = [f"k={x.kind}", f"k={x.kind}|in={x.open}", f"k={x.kind}|prev={items[i - 1].kind if i else 'start'}", f"k={x.kind}|next={items[i + 1].kind if i + 1 < len(items) else 'end'}", f"k={x.kind}|title={title}"]
        f += [f"k={x.kind}|page={p}" for p in page]
        if not page:
            f.append(f"k={x.kind}|page=none")
        if x.kind in ("tag", "environment", "command", "entity", "bare"):
            name = re.search(r"[A-Za-z]+[0-9]?|#", x.text.lstrip("<\\/&"))
            f.append(f"n={name.group().lower() if name else ''}")
        if x.kind in ("bullet", "wikibullet", "number", "ones", "quote"):
            mark = x.text.strip()[:1]
            same = len(re.findall(rf"(?m)^[ \t]*{re.escape(mark)}", text)) if mark else 0
            tight = x.text[-1:] not in (" ", "\t")
            f += [f"mark={mark}", f"mark={mark}|many={min(same, 3)}", f"mark={mark}|tight={tight}", f"blank={text[max(0, line_start - 2) : line_start] == chr(10) * 2}|{mark}"]
        if x.kind == "odd":
            around = text[max(0, x.start - 1) : x.start] + x.text + text[x.end : x.end + 1]
            f += [f"odd={x.text}", "odd=" + re.sub(r"\w", "w", re.sub(r"\d", "9", around)), f"odd={x.text}|{line.count(x.text) > 1}"]
        if x.kind in ("emph", "strong", "math", "template", "external", "inlinecode"):
            f.append(f"w={min(len(_WORDS.findall(x.text)), 4)}|{x.kind}")
            f.append(f"d={bool(re.search(r'[0-9]', x.text))}|{x.kind}|{x.text[:1]}")
        if x.kind in ("math", "display"):
            f.append(f"tex={bool(re.search(r'[\\^_{}=]', x.text))}|{x.kind}")
        out.append(f)
    return out


class Chain:
    """A linear chain over LABELS."""

    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def potentials(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), len(LABELS)))
        for i, f in enumerate(feats):
            for x in f:
                v = self.w.get(x)
                if v is not None:
                    out[i] += v
        return out

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        if not feats:
            return []
        u = self.potentials(feats)
        best, back = u[0], []
        for i in range(1, len(u)):
            s = best[:, None] + self.t
            back.append(s.argmax(0))
            best = s.max(0) + u[i]
        y = [int(best.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], passes: int, rng: random.Random) -> None:
        """Adagrad on the conditional log-likelihood, by forward and backward sums."""
        norm: dict[str, np.ndarray] = {}
        tnorm = np.full_like(self.t, 1e-2)
        eye = np.eye(len(LABELS))
        lse = lambda m, axis: (x := m.max(axis=axis, keepdims=True), (x + np.log(np.exp(m - x).sum(axis=axis, keepdims=True))).squeeze(axis))[1]
        for _ in range(passes):
            rng.shuffle(pages)
            for feats, gold in pages:
                if not feats:
                    continue
                u = self.potentials(feats)
                n = len(u)
                a, b = u.copy(), np.zeros_like(u)
                for i in range(1, n):
                    a[i] += lse(a[i - 1][:, None] + self.t, 0)
                for i in range(n - 2, -1, -1):
                    b[i] = lse(self.t + (u[i + 1] + b[i + 1])[None], 1)
                z = lse(a[-1], 0)
                p = np.exp(a + b - z)
                g = eye[gold] - p
                gt = np.zeros_like(self.t)
                for i in range(1, n):
                    gt -= np.exp(a[i - 1][:, None] + self.t + (u[i] + b[i])[None] - z)
                    gt[gold[i - 1], gold[i]] += 1
                tnorm += gt * gt
                self.t += 0.1 * gt / np.sqrt(tnorm)
                for i, f in enumerate(feats):
                    if np.abs(g[i]).max() < 1e-3:
                        continue
                    for x in f:
                        if x not in norm:
                            norm[x], self.w[x] = np.full(len(LABELS), 1e-2), np.zeros(len(LABELS))
                        norm[x] += g[i] * g[i]
                        self.w[x] += 0.3 * g[i] / np.sqrt(norm[x])


def labelled_pages(count: int, rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]], bool]]:
    """(text, spans (start, end, label), whether a title): pages composed of marked-up and plain pieces.

    Parts in ‹label:...› are labelled; everything else is plain.
    """

    def w() -> str:
        s = "".join(rng.choice(("br", "cl", "d", "f", "g", "k", "l", "m", "n", "p", "s", "t", "v", "w", "z")) + rng.choice("aeiou") + rng.choice(("", "n", "r", "st", "x")) for _ in range(2))
        return s.capitalize() if rng.random() < 0.3 else s

    def words(a: int = 3, b: int = 9) -> str:
        return " ".join(w() for _ in range(rng.randint(a, b)))

    def n() -> str:
        return str(rng.randint(1, 999))

    def sentence() -> str:
        return words().capitalize() + rng.choice((".", ".", "!", f" {n()} rows."))

    inline = {
        "html": lambda: rng.choice((f"‹html:<em>›{w()}‹html:</em>›", f"‹html:<b>›{w()}‹html:</b>›", f"‹html:<strong>›{w()}‹html:</strong>›", f'‹html:<a href="/kb/{w()}">›{w()}‹html:</a>›', f"‹html:<A HREF='/{w()}'>›{w()}‹html:</A>›", f"{w()}‹html:&{rng.choice(('amp', 'nbsp', 'lt', 'gt', 'quot', 'eacute', '#8217', '#39', 'mdash', 'uuml'))};›", "‹html:<br>›", "‹html:<br/>›", f"‹html:<!-- {w()} -->›", f"‹html:<code>{w()}</code>›", f'‹html:<span class="{w()}">›{w()}‹html:</span>›')),
        "markdown": lambda: rng.choice((f"‹markdown:**{w()}**›", f"‹markdown:__{w()}__›", f"‹markdown:*{w()}*›", f"‹markdown:_{w()}_›", f"‹markdown:[{w()}](/kb/{w()})›", f"‹markdown:[{w()}][ref-{w()}]›", f"‹markdown:![{w()}](img/{w()}.png)›", f"‹markdown:`{w()}`›", f"‹markdown:~~{w()}~~›")),
        "wiki": lambda: rng.choice((f"‹wiki:[[{w()}]]›", f"‹wiki:[[{w()}|{w()} page]]›", f"‹wiki:'''{w()}'''›", f"‹wiki:''{w()}''›", "‹wiki:{{note}}›", f"‹wiki:{{{{stub|{w()}}}}}›")),
        "latex": lambda: rng.choice((f"‹latex:\\emph{{{w()}}}›", f"‹latex:\\textbf{{{w()}}}›", f"‹latex:\\textit{{{w()}}}›", f"{w()}‹latex:~\\cite{{{w()}}}›", f"‹latex:\\ref{{sec:{w()}}}›", f"‹latex:$x_{{{rng.randint(1, 9)}}}^{{2}}$›", "‹latex:$\\alpha$›", f"‹latex:$\\alpha_{{{n()}}} \\le \\sqrt{{{n()} n}}$›", f"‹latex:$\\frac{{{n()} x + {n()}}}{{y^{{3}}}}$›", f"‹latex:\\url{{{w()}}}›", "‹latex:\\%›")),
        "plain": lambda: rng.choice((f"${n()} to ${n()}", f"{n()} * {n()} * {n()} cells", "{draft -> review -> done}", f"R&D and Q&A notes in C:\\{w()}\\{w()}", f"a < {n()} and b > {n()}", f"snake_{w()}_case", f"~{n()} rows", f"#{n()}", f"@{w()}", f"[{n()}]", f"it's {w()}'s", f"{w()} -> {w()}", f"5 * {n()}", f"x = {n()}", f"AT&T {w()}", f"<{n()} ms", f"{w()}@{w()}.example", f"[old] {w()}", f"({n()})", f"https://{w()}.example/{w()}", f"'{w()}'", f"f({w()}, *args)", f'{{"owner": "{w()}", "mail": "{w()}"}}', f"--{w()}", f"{w()}*", f"${n()} tier")),
    }
    code = lambda: rng.choice((f"# {w()}\nexport {w().upper()}_MODE={w()}", f"def {w()}_{w()}(rows):\n    return [r for r in rows if r.score > 0.85]", f'<panel id="{w()}">\n  <row>{w()}</row>\n</panel>', f"SELECT id, score FROM {w()}\nWHERE term = '{w()}'\nLIMIT 15;", f'{{"{w()}": 75, "{w()}": ["{w()}", "{w()}"]}}', f"{w()} --pool {w()} --retries 6", f"$ {w()} **{w()} && [[ -f {w()} ]]"))
    math_ = lambda: rng.choice((f"s = \\sum_{{i=1}}^{{{n()}}} w_i / (k + r_i)", f"P(q \\mid d) = \\prod_t \\lambda^{{{n()}}} p_t", f"\\frac{{{n()} x + {n()}}}{{y^{{3}}}}"))

    def items(mark: str, label: str) -> str:
        return "\n".join((f"‹{label}:{mark}›" if label != "plain" else mark) + words(2, 5) for _ in range(rng.randint(2, 5)))

    blocks = {
        "html": lambda: rng.choice((f"‹html:<p>›{words(5, 12)} {inline['html']()} {words()}.‹html:</p>›", f"‹html:<h{rng.randint(1, 4)}>›{words(2, 4)}‹html:</h3>›", "‹html:<ul>›\n" + "\n".join(f"‹html:<li>›{words(2, 4)}‹html:</li>›" for _ in range(3)) + "\n‹html:</ul>›", "‹html:<table>›" + "".join(f"‹html:<tr>›‹html:<td>›{w()}‹html:</td>›‹html:<td>›{n()}‹html:</td>›‹html:</tr>›" for _ in range(2)) + "‹html:</table>›", f"‹html:<pre><code>{html.escape(code())}</code></pre>›", f'‹html:<p class="lead">›{words()}‹html:</P>›', f"‹html:<div>›{words()}‹html:</div>›")),
        "markdown": lambda: rng.choice((f"‹markdown:{'#' * rng.randint(1, 4)} {words(2, 4)}›", items(rng.choice(("- ", "* ")), "markdown"), items("- [ ] ", "markdown"), items("1. ", "markdown"), f"‹markdown:| {w()} | {w()} |›\n‹markdown:|---|---|›\n‹markdown:| {w()} | {n()} |›\n‹markdown:| {w()} | {n()} |›", f"‹markdown:```{rng.choice(('', 'sql', 'text', 'python'))}\n{code()}\n```›", f"{words()} {inline['markdown']()} {words()}.", f"‹markdown:> ›{words()}")),
        "wiki": lambda: (lambda e: rng.choice((f"‹wiki:{e} {words(2, 4)} {e}›", "‹wiki:{| class=\"grid\"›\n‹wiki:|-›\n" + f"‹wiki:| {w()} || {n()}›\n‹wiki:|-›\n‹wiki:| {w()} || {n()}›\n" + "‹wiki:|}›", "\n".join(f"‹wiki:*›{words(2, 4)}" for _ in range(3)), "\n".join(f"‹wiki:#›{words(2, 4)}" for _ in range(3)), f"{words()} {inline['wiki']()} {words()}.", f"‹wiki:<syntaxhighlight>{code()}</syntaxhighlight>›")))("=" * rng.randint(2, 4)),
        "latex": lambda: rng.choice((f"‹latex:\\subsection{{{words(2, 4)}}}›", "‹latex:\\begin{itemize}›\n" + "\n".join(f"‹latex:\\item› {words(2, 4)}" for _ in range(3)) + "\n‹latex:\\end{itemize}›", f"‹latex:\\begin{{verbatim}}\n{code()}\n\\end{{verbatim}}›", "‹latex:\\begin{equation}›\n" + f"‹latex:{math_()}›" + "\n‹latex:\\end{equation}›", f"‹latex:$${math_()}$$›", f"{words()} {inline['latex']()} {words()}.")),
        "plain": lambda: rng.choice((items(rng.choice(("(1) ", "• ", "a) ", "")), "plain"), words(2, 4).upper(), f"{words()} {inline['plain']()} {words()}.", "-- end of page --", f"See also {w()}, {w()}", f"kb/{w()}/{w()}", " ".join(sentence() for _ in range(rng.randint(1, 4))), f"2026-03-02 20:43:04 ERROR {words()}")),
    }
    titles = {
        "html": lambda: rng.choice((f"‹html:<h1>›{words(2, 5)}‹html:</h1>›", f"‹html:<b>›{words(2, 4)}‹html:</b>›", f"{words(2, 4)}‹html:<br>›", f"{words(2, 4)} ‹html:&amp;› more", f"‹html:&quot;›{words(2, 4)}‹html:&quot;›")),
        "markdown": lambda: rng.choice((f"‹markdown:# {words(2, 4)}›", f"‹markdown:**{words(2, 4)}**›", f"‹markdown:`{words(2, 4)}`›", f"‹markdown:[{words(2, 4)}]({w()}.md)›")),
        "wiki": lambda: rng.choice((f"‹wiki:== {words(2, 4)} ==›", f"‹wiki:=== {words(2, 4)} ===›", f"‹wiki:[[{words(2, 4)}]]›", f"‹wiki:'''{words(2, 4)}'''›", f"{words(2, 4)} ‹wiki:{{{{draft}}}}›")),
        "latex": lambda: rng.choice((f"‹latex:\\section{{{words(2, 4)}}}›", f"‹latex:\\title{{{words(2, 4)}}}›", f"‹latex:\\textit{{{words(2, 4)}}}›", f"{words(2, 4)} ‹latex:$\\alpha$›")),
        "plain": lambda: rng.choice((words(2, 6), f"{words(2, 4)} #2", f"[old] {words(2, 4)}", f"{words(2, 4)} *", f"{words(2, 4)} < v2", f"{words(2, 4)}: ${n()} tier", f"d'{w()} {words(2, 3)}", words(2, 4).upper(), f"C:\\{w()} {w()}", f"R&D {words(1, 3)}")),
    }
    out = []
    for _ in range(count):
        title = rng.random() < 0.25
        if title:
            raw = titles[rng.choice(("plain", "plain", *MARKUPS))]()
        else:
            main = rng.choice(("plain", "plain", *MARKUPS))
            parts = []
            for _ in range(rng.randint(1, 5)):
                kind = main if rng.random() < 0.7 else "plain" if rng.random() < 0.8 else rng.choice(MARKUPS)
                parts.append(blocks[kind]() if rng.random() < 0.6 else f"{words()} {inline[kind]()} {words()}.")
            raw = rng.choice(("\n\n", "\n")).join(parts)
        text, spans, at = "", [], 0
        for m in re.finditer(r"‹(\w+):(.*?)›", raw, re.S):
            text += raw[at : m.start()]
            spans.append((len(text), len(text) + len(m.group(2)), m.group(1)))
            text += m.group(2)
            at = m.end()
        out.append((text + raw[at:], spans, title))
    return out


def gold_labels(items: list[Leaf], spans: list[tuple[int, int, str]]) -> list[int]:
    """The label of each leaf: that of the span that it overlaps most, else plain."""
    out = []
    for x in items:
        best = max(((min(x.end, b) - max(x.start, a), label) for a, b, label in spans if a < x.end and x.start < b), default=(0, "plain"))
        out.append(LABELS.index(best[1] if x.kind != "prose" or best[0] > (x.end - x.start) / 2 else "plain"))
    return out


def trained(count: int = PAGES, passes: int = PASSES, seed: int = SEED) -> Chain:
    """A chain trained on made-up labelled pages; the same for the same arguments."""
    rng = random.Random(seed)
    pages = []
    for text, spans, title in labelled_pages(count, rng):
        items = leaves(text)
        pages.append((features(items, text, title), gold_labels(items, spans)))
    chain = Chain()
    chain.train(pages, passes, rng)
    return chain


def labelled(text: str, title: bool, chain: Chain) -> list[tuple[Leaf, str]]:
    if not _ANY.search(text):
        return [(Leaf("prose", 0, len(text), text, ""), "plain")] if text.strip() else []
    items = leaves(text)
    if all(x.kind == "prose" for x in items):
        return [(x, "plain") for x in items]
    return [(x, LABELS[y]) for x, y in zip(items, chain.viterbi(features(items, text, title)), strict=True)]


def clean(text: str, found: list[tuple[Leaf, str]]) -> str:
    """The text without its markup and with its structure in one notation: headings as lines with as many # as their level,
    list items with a dash, code blocks between lines of three backticks, table cells between bars, formulas as they are."""
    out, at = [], 0
    for x, label in found:
        if label in MARKUPS:
            out.append(text[at : x.start])
            out.append(_plain(x))
            at = x.end
    out.append(text[at:])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


def _block(code: str) -> str:
    return "```\n" + code.strip("\n") + "\n```"


def _plain(x: Leaf) -> str:
    s = x.text
    if x.kind in ("pre", "codetag", "source"):
        inner = html.unescape(re.sub(r"(?i)</?(?:pre|code|syntaxhighlight|source|nowiki)\b[^>]*>", "", s))
        return inner if x.kind == "codetag" else _block(inner)
    if x.kind in ("tag", "tornTag"):
        name = re.search(r"[A-Za-z]+[0-9]?", s)
        tag = name.group().lower() if name else ""
        if tag == "li" and not s.startswith("</"):
            return "- "
        if re.fullmatch(r"h[1-6]", tag) and not s.startswith("</"):
            return "\n" + "#" * int(tag[1]) + " "
        return "\n" if tag in ("br", "p", "div", "tr", "li") or re.match(r"h\d$", tag) else " | " if tag in ("td", "th") and s.startswith("</") else ""
    if x.kind == "entity":
        return html.unescape(s).replace("\u00a0", " ")
    if x.kind in ("comment", "environment", "mdrule", "single"):
        return ""
    if x.kind == "fence":
        return _block("\n".join(s.strip().split("\n")[1:]).removesuffix("```").removesuffix("~~~"))
    if x.kind == "verbatim":
        return _block(re.sub(r"\\(?:begin|end)\{[a-z]+\}", "", s))
    if x.kind in ("math", "display", "odd", "prose"):
        return s
    if x.kind == "command":
        name = re.match(r"~?\\([A-Za-z]+)", s)
        if name and (level := {"title": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}.get(name.group(1))):
            return "#" * level + " " + re.sub(r"^~?\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{|\}$", "", s)
        return "" if name and name.group(1) in ("cite", "ref", "label", "eqref", "citep", "citet") else re.sub(r"^~?\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{|\}$", "", s)
    if x.kind == "bare":
        return "-" if s.startswith("\\item") else s[1:] if re.match(r"\\[%&#_$]", s) else ""
    if x.kind == "wikitable":
        return "" if s.startswith(("{|", "|}", "|-", "|+")) else " | ".join(c.strip() for c in re.split(r"\|\||!!", s.lstrip("|!")))
    if x.kind == "wikilink":
        return s[2:-2].split("|")[-1].removesuffix(" page") if s.endswith(" page]]") else s[2:-2].split("|")[-1]
    if x.kind == "template":
        return s[2:-2].split("|")[-1] if "|" in s else ""
    if x.kind == "wikiheading":
        bare = s.strip()
        level = (len(bare) - len(bare.lstrip("="))) or 1
        return "#" * max(1, level - 1) + " " + bare.strip("=").strip()
    if x.kind == "mdheading":
        return "#" * (len(s) - len(s.lstrip("#"))) + " " + s.lstrip("#").strip()
    if x.kind in ("link", "reflink", "image"):
        return re.sub(r"^!?\[([^\]]*)\].*$", r"\1", s, flags=re.S)
    if x.kind == "external":
        return s.strip("[]").partition(" ")[2]
    if x.kind == "mdrow":
        return " | ".join(c.strip() for c in s.strip().strip("|").split("|"))
    if x.kind in ("task", "bullet", "wikibullet", "ones", "number"):
        return "- "
    if x.kind == "quote":
        return ""
    return s.strip("*_~`'")


def clean_texts(rows: DataFrame) -> DataFrame:
    """rows(field, key, text) -> (field, key, markups array<string>, cleaned) for every row.

    markups are the kinds of markup left in the text, each once, without what stands inside of code samples; cleaned is
    the text without them. Null and empty texts have none and stay as they are; repeated keys have a row each; an empty
    table gives none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(trained())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = shared.value
        for f in frames:
            kinds, cleaned = [], []
            for field, text in zip(f["field"], f["text"], strict=True):
                found = labelled(text, field == "title", chain) if text else []
                kinds.append(sorted({y for _, y in found if y in MARKUPS}))
                cleaned.append(clean(text, found) if text else text)
            yield pd.DataFrame({"field": f["field"], "key": f["key"], "markups": kinds, "cleaned": cleaned})

    return rows.select("field", "key", "text").mapInPandas(run, "field string, key string, markups array<string>, cleaned string")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "documents").where("doc_id is not null").select(F.lit("title").alias("field"), F.col("doc_id").cast("string").alias("key"), F.col("title").alias("text"))
    chunks = once(table(spark, folder, "chunks").select("chunk_id", "content", "created_at"), "chunk_id", F.desc_nulls_last("created_at"), F.col("content"))
    return titles.unionByName(chunks.select(F.lit("content").alias("field"), F.col("chunk_id").alias("key"), F.col("content").alias("text")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of markup left in titles and contents."""
    return clean_texts(_texts(spark, folder)).select(F.col("field").alias("field_name"), F.col("key").alias("record_key"), F.explode("markups").alias("markup"))


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and contents without markup."""
    return clean_texts(_texts(spark, folder)).select(F.col("field").alias("field_name"), F.col("key").alias("record_key"), "cleaned")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
ORACLES: dict[str, str] = {}
