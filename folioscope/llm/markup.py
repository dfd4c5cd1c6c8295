"""Markup residue: a recurrent labeller over the leaves of a document, and the clean text made from its labels.

A scanner cuts a text (HTML, Markdown, wiki or LaTeX, mixed or none) into a sequence of leaves: marks, elements
and the prose between them, each with its tag path (kind of mark, element name, enclosing element, place in the
line, shape and signs of what it holds) and its words. Both are hashed into one vector per leaf. A bidirectional
LSTM in numpy reads the whole sequence and gives every mark its label in the light of the whole document: text (the
characters are meant), heading, list, code, formula, or other markup. The form of a mark decides nothing: any label
is open to every mark, and the map from tag paths to labels is learned. Only prose between marks is text by itself.

The scanner takes time in proportion to the text: closing marks and pairs of braces are found in one pass each, and
no pattern runs beyond the next opening mark of its kind.

The network is fitted here, on documents that a seeded generator writes with known labels; see ``train``.
"""

from __future__ import annotations

import functools
import heapq
import html
import html.entities
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ["text", "heading", "list", "code", "formula", "other"]
TEXT, HEADING, LIST, CODE, FORMULA, OTHER = range(6)
PATH_DIMS, WORD_DIMS, HIDDEN = 512, 32, 16
#: Training: generated documents, epochs, documents of one step and seed. These bound the cost, nothing about the corpus.
TRAIN_DOCS, EPOCHS, BATCH, SEED = 3000, 10, 50, 11
_DIMS = PATH_DIMS + WORD_DIMS

# Element and environment names by what they mark up.
CODE_TAGS = "pre|code|source|syntaxhighlight|tt|samp|kbd|nowiki"
MATH_TAGS = "math|chem"
CODE_ENVS = "verbatim|Verbatim|lstlisting|minted|alltt"
MATH_ENVS = "equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat|split|cases|array"
LIST_ENVS = "itemize|enumerate|description"
SECTIONS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title"

#: kind -> labels that generated documents give it; the first is the usual one. The network is free to depart from it.
TAUGHT: dict[str, tuple[int, ...]] = {
    "prose": (TEXT,), "fence": (CODE,), "ticks": (CODE, TEXT), "html_code": (CODE,), "tex_code": (CODE,), "verb": (CODE,),
    "html_math": (FORMULA,), "tex_env_math": (FORMULA,), "tex_display": (FORMULA,), "tex_inline": (FORMULA,),
    "dollars": (FORMULA,), "dollar": (FORMULA, TEXT), "atx": (HEADING, LIST, TEXT), "wiki_head": (HEADING, TEXT),
    "setext": (HEADING,), "html_head": (HEADING,), "tex_head": (HEADING,), "bullet": (LIST, TEXT), "number": (LIST, TEXT),
    "html_list": (LIST,), "tex_list": (LIST,), "tex_item": (LIST,), "tag": (OTHER,), "comment": (OTHER,),
    "entity": (OTHER,), "strong": (OTHER, TEXT), "em": (OTHER, TEXT), "under": (OTHER, TEXT), "strike": (OTHER,),
    "wiki_em": (OTHER, TEXT), "wiki_link": (OTHER, TEXT), "link": (OTHER,), "image": (OTHER,), "ext_link": (OTHER,),
    "footnote": (OTHER,), "quote": (OTHER, TEXT), "table": (OTHER, TEXT), "template": (OTHER,), "tex_quote": (OTHER,),
    "command": (OTHER,), "accent": (OTHER,), "escape": (OTHER,), "rule": (OTHER, TEXT), "env": (OTHER,), "close": (TEXT,),
    "autolink": (OTHER,), "linebreak": (OTHER,),
}

_F = re.S | re.M
#: kind, pattern, what closes the element ("" where the pattern is the whole leaf; {} is group 1), on one line only
Rule = tuple[str, re.Pattern, str, bool]


def _rules(*rules: tuple) -> list[Rule]:
    return [(r[0], re.compile(r[1], _F), r[2] if len(r) > 2 else "", len(r) > 3) for r in rules]


LINE_ONLY = True
# By first character: rules tried in order at a place. Group 1, where there is one, is what the leaf holds; a
# group "open" ends the leaf early, so that what follows is scanned on its own.
INLINE = {
    "<": _rules(
        ("comment", r"<!--.*?(?:-->|\Z)"),
        ("html_code", rf"(?i:<({CODE_TAGS})\b[^<>]*>)", r"(?i:</{}\s*>)"),
        ("html_math", rf"(?i:<({MATH_TAGS})\b[^<>]*>)", r"(?i:</{}\s*>)"),
        ("close", r"(?i:</(?:h[1-6]|li|ul|ol|dl|dt|dd)\s*>)"),
        ("html_head", r"(?i:<h[1-6](?:\s[^<>]*)?>)"),
        ("html_list", r"(?i:<(?:ul|ol|li|dl|dt|dd)(?:\s[^<>]*)?>)"),
        ("autolink", r"<(?:https?://|mailto:)[^<>\s]+>"),
        ("tag", r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>"),
    ),
    "\\": _rules(
        ("tex_code", rf"\\begin\{{({CODE_ENVS})\*?\}}", r"\\end\{{{}\*?\}}"),
        ("tex_env_math", rf"\\begin\{{({MATH_ENVS})\*?\}}", r"\\end\{{{}\*?\}}"),
        ("tex_list", rf"\\begin\{{(?:{LIST_ENVS})\*?\}}"),
        ("close", rf"\\end\{{(?:{LIST_ENVS})\*?\}}"),
        ("env", r"\\begin\{[a-zA-Z]+\*?\}(?:\{[^{}\n]*\}|\[[^\[\]\n]*\])*"),
        ("close", r"\\end\{[a-zA-Z]+\*?\}"),
        ("tex_item", r"\\item\b(?:\[[^\[\]\n]*\])?"),
        ("tex_head", rf"\\(?:{SECTIONS})\*?(?:\[[^\[\]\n]*\])?\{{"),
        ("verb", r"\\verb\*?([0-9!-)+-/:-@\[-`{-~])", "{}", LINE_ONLY),
        ("verb", r"\\(?:lstinline|mintinline)(?:\[[^\[\]]*\])?\{[^{}\n]*\}"),
        ("tex_display", r"\\\[", r"\\\]"),
        ("tex_inline", r"\\\(", r"\\\)"),
        ("accent", r"\\[`'^\"~=.](?:\{\\?[a-zA-Z]\}|\\?[a-zA-Z])"),
        ("accent", r"\\[cHkvurdbt]\{[a-zA-Z]\}"),
        ("command", r"\\[a-zA-Z]{2,}\*?(?:\[[^\[\]\n]*\])?\{?"),
        ("command", r"\\(?:ss|ae|oe|o|l|i|j|aa|O|L|S|P)\b"),
        ("linebreak", r"\\\\(?=\s|$)"),
        ("escape", r"\\[%&#_{}$*`\[\]()!>~^+.-]"),
    ),
    "$": _rules(("dollars", r"\$\$(?=[^$])", r"\$\$"), ("dollar", r"\$((?=\S)[^$\n]+?(?<=\S))\$(?!\d)")),
    "`": _rules(
        ("fence", r"(?<![^\n])(`{3,})[^\n]*\n.*?(?:^\1\s*$|\Z)"), ("ticks", r"`{2}(?!`)(?=[^\n])", r"(?<=[^`\n])`{{2}}(?!`)", LINE_ONLY),
        ("tex_quote", r"``([^`\n]+?)''"), ("ticks", r"`([^`\n]+)`"),
    ),
    "~": _rules(("fence", r"(?<![^\n])(~{3,})[^\n]*\n.*?(?:^\1\s*$|\Z)"), ("strike", r"~~(?=[^\s~])", r"(?<=\S)~~", LINE_ONLY)),
    "*": _rules(("strong", r"\*{2,3}(?=[^\s*])([^*\n]+?)(?<=\S)\*{2,3}"), ("em", r"\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?!\*)")),
    "_": _rules(
        ("strong", r"(?<![\w_])__(?=[^\s_])", r"(?<=[^\s_])__(?![\w_])", LINE_ONLY),
        ("under", r"(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])"),
    ),
    "'": _rules(("wiki_em", r"'{2,5}(?=[^\s'])", r"'{{2,5}}", LINE_ONLY)),
    "[": _rules(
        ("wiki_link", r"\[\[", r"\]\](?!\])", LINE_ONLY), ("footnote", r"\[\^([^\[\]\s]+)\]:?"), ("link", r"\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"),
        ("ext_link", r"\[(?=(?:https?|ftp)://[^\s\]])", r"\]", LINE_ONLY), ("link", r"(?<![^\n])\[[^\]\n]+\]:[ \t]+\S+"), ("link", r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"),
    ),
    "!": _rules(("image", r"!\[([^\[\]\n]*)\]\([^()\n]*\)")),
    "{": _rules(("template", r"\{\{([^{}]*)\}\}"), ("table", r"(?<![^\n])\{\|[^\n]*")),
    "&": _rules(("entity", r"&(#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")),
}
LINE = _rules(
    ("setext", r"(?P<open>(?<=[^\n]\n)(?:={3,}|-{3,})[ \t]*$)"),
    ("rule", r"[ \t]*(?:-[ \t]*){4,}$|[ \t]*(?:\*[ \t]*){3,}$|[ \t]*(?:_[ \t]*){3,}$"),
    ("table", r"\|[-}+][^\n]*$|\|(?:[^|\n]*\|)+[ \t]*[^|\n]*$|![^!\n]+!![^\n]*$|\|\s[^|\n]*$"),
    ("wiki_head", r"(?P<open>(={1,6})(?=[^=\n]))[^\n]*?[^=\n]\2[ \t]*$"),
    ("atx", r"(?P<open>[ ]{0,3}#{1,6}[ \t]+)(?=\S)"),
    ("bullet", r"(?P<open>[ \t]*(?:[-+]|[*]{1,4})[ \t]+)(?=\S)"),
    ("number", r"(?P<open>[ \t]*\d+[.)][ \t]+)(?=\S)"),
    ("quote", r"(?P<open>[ ]{0,3}>+[ \t]?)"),
)
_TRIGGER = re.compile(r"[<\\$`~*_\[!{&]|''|^[ \t]*(?:[-+=>|#]|\d+[.)][ \t])", re.M)
#: What a text must hold to have any leaf but prose; also a condition for the scan in Spark.
ANY_MARK = r"[<\\$`~*_\[{&]|''|!\[|(?m)^[ \t]*(?:[-+=>|#]|\d+[.)][ \t])"
_BRACE = re.compile(r"(?<!\\)[{}]")
_WORD = re.compile(r"[^\W\d_]+")
_SHAPES = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\s+"))
_NAME = re.compile(r"[<\\]/?(?:begin\{|end\{)?(\w+)")
_SIGNS = re.compile(r"[\\^_={}|,:#/]")

Leaf = tuple[str, int, int, str, str]  # kind, start, end, tag path, what it holds


def _shape(held: str) -> str:
    held = held[:24]
    for pattern, sign in zip(_SHAPES, "a9 "):
        held = pattern.sub(sign, held)
    return held[:5]


class _Places:
    """A text with what is looked up in it again and again; each kind of mark is sought in one pass."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._line = (0, -1)
        self._closers: dict[str, tuple[list[int], list[int]]] = {}
        self._pairs: dict[int, int] | None = None

    def line_end(self, at: int) -> int:
        if not self._line[0] <= at <= self._line[1]:
            end = self.text.find("\n", at)
            self._line = (at, end if end >= 0 else len(self.text))
        return self._line[1]

    def closer(self, pattern: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the first match of ``pattern`` from ``at`` on."""
        if pattern not in self._closers:
            spans = [m.span() for m in re.finditer(pattern, self.text)]
            self._closers[pattern] = ([a for a, _ in spans], [b for _, b in spans])
        starts, ends = self._closers[pattern]
        i = bisect_left(starts, at)
        return (starts[i], ends[i]) if i < len(starts) else None

    def closing_brace(self, opened: int) -> int | None:
        if self._pairs is None:
            self._pairs, stack = {}, []
            for m in _BRACE.finditer(self.text):
                if m.group() == "{":
                    stack.append(m.start())
                elif stack:
                    self._pairs[stack.pop()] = m.start()
        return self._pairs.get(opened)


def _entity(name: str) -> bool:
    if name[0] != "#":
        return name + ";" in html.entities.html5
    digits = name[2:] if name[1] in "xX" else name[1:]
    digits = digits.lstrip("0")
    return 0 < len(digits) <= 7 and int(digits, 16 if name[1] in "xX" else 10) < 0x110000


def leaves(text: str) -> list[Leaf]:
    """The leaves of a text in order; together they cover it."""
    out: list[Leaf] = []
    at = look = 0
    inside = "-"
    n = len(text)
    places = _Places(text)
    braces: list[int] = []  # a heap of the places of the braces that close what a command opened
    number, last_line, mark_line = "", 0, -1

    def prose(start: int, end: int) -> None:
        while braces and braces[0] < end:
            brace = heapq.heappop(braces)
            if brace < start:
                continue
            if brace > start:
                out.append(("prose", start, brace, f"prose {inside}", text[start:brace]))
            out.append(("close", brace, brace + 1, "close brace", ""))
            start = brace + 1
        if start < end:
            out.append(("prose", start, end, f"prose {inside}", text[start:end]))

    while look < n:
        m = _TRIGGER.search(text, look)
        if m is None:
            break
        start = m.start()
        first = text[start]
        at_line = start == 0 or text[start - 1] == "\n"
        kind = hit = close = None
        if at_line:
            for k, p, _, _ in LINE:
                hit = p.match(text, start)
                if hit:
                    kind = k
                    break
        if kind is None:
            if first in " \t" or first.isdigit():  # blanks before a mark at the start of a line
                start = m.end() - 1
                first = text[start]
            for k, p, closer, one_line in INLINE.get(first, ()):
                hit = p.match(text, start)
                if hit and closer:
                    name = hit.group(1) if hit.re.groups else ""
                    close = places.closer(closer.format(re.escape(name.lower() if k.startswith("html") else name)), hit.end())
                    if close is None or (one_line and close[0] > places.line_end(hit.end())):
                        hit = close = None
                if hit and k == "entity" and not _entity(hit.group(1)):
                    hit = None
                if hit:
                    kind = k
                    break
        if kind is None:
            look = start + 1 if first != "'" else start + 2
            continue
        opens = hit.groupdict().get("open") is not None
        end = hit.end("open") if opens else close[1] if close else hit.end()
        if kind == "setext" and start - at < 1:
            kind = "rule"
        if start > at:
            prose(at, start)
        if opens:
            held = text[end : places.line_end(end)]
        elif hit.re.groups and hit.group(1):
            held = hit.group(1)
        else:
            held = text[hit.end() : close[0]] if close else hit.group()
        named = _NAME.match(text, start)
        signs = "".join(sorted(set(_SIGNS.findall(held))))
        more = f"n:{named.group(1).lower()}" if named else f"{kind}:{signs}"
        if kind in ("atx", "bullet", "wiki_head"):
            more = f"{kind}:{hit.group().strip()[:7]}" if kind != "wiki_head" else f"wiki_head{end - start}"
        elif kind == "number":  # does it go on from the number before?
            digits = hit.group().strip(" \t.)").lstrip("0")
            following = number.isdigit() and len(number) < 19 and digits == str(int(number) + 1)
            more = "seq" if following else "one" if digits in ("", "1") else f"lone{min(len(digits), 4)}"
            number = digits
        if opens:  # marks like it on the lines before and after?
            after = places.line_end(end) + 1
            more += f" {kind}<{mark_line == start and text[last_line] == first}>{text[after : after + 1] == first} {kind}/{held.rstrip()[-1:]}"
        if at_line:
            last_line, mark_line = start, places.line_end(end) + 1
        path = f"{kind} {inside} {kind}/{'bol' if at_line else 'mid'} {kind}/{_shape(held)} {kind}/{first} {more}"
        out.append((kind, start, end, path, held))
        if kind in ("html_list", "tex_list", "html_head", "env"):
            inside = kind
        elif kind == "close":
            inside = "-"
        if text[end - 1] == "{" and kind in ("command", "tex_head"):
            brace = places.closing_brace(end - 1)
            if brace is not None:
                heapq.heappush(braces, brace)
        at = look = max(end, start + 1)
    if at < n:
        prose(at, n)
    return out


@functools.lru_cache(maxsize=200_000)
def _bucket(token: str, dims: int) -> int:
    return zlib.crc32(token.encode()) % dims


def vectors(flat: list[Leaf]) -> np.ndarray:
    """One row per leaf: hashed tag path, then hashed words (log counts)."""
    places: list[int] = []
    for row, leaf in enumerate(flat):
        base = row * _DIMS
        places += [base + _bucket(t, PATH_DIMS) for t in leaf[3].split(" ")]
        places += [base + PATH_DIMS + _bucket(w, WORD_DIMS) for w in _WORD.findall(leaf[4])]
    counts = np.bincount(np.array(places, dtype=np.int64), minlength=len(flat) * _DIMS)
    return np.log1p(counts.astype(np.float32)).reshape(len(flat), _DIMS)


# ---- the network -------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(pre: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """pre: what the leaves add to the gates (steps, batch, gates); a masked step leaves the state as it was."""
    steps, batch, _ = pre.shape
    size = u.shape[0]
    h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    hs, tape = np.empty((steps, batch, size), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ u
        i, f, o = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        m = mask[t][:, None]
        new = f * c + i * g
        th = np.tanh(new)
        if keep:
            tape.append((i, f, o, g, c, th, h))
        c = np.where(m, new, c)
        h = np.where(m, o * th, h)
        hs[t] = h
    return hs, tape


def _lstm_back(x, mask, u, tape, dhs):
    steps, batch, _ = x.shape
    size = u.shape[0]
    dz_all = np.zeros((steps, batch, 4 * size), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, th, h = tape[t]
        m = mask[t][:, None]
        dh = dh + dhs[t]
        live = dh * m
        dnew = dc * m + live * o * (1 - th**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh = dz @ u.T + dh * ~m
        dc = dnew * f + dc * ~m
    dims = x.shape[2]
    return x.reshape(-1, dims).T @ dz_all.reshape(-1, 4 * size), du, dz_all.sum(axis=(0, 1))


def _placed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask (steps, batch), and the flat place (step * batch + doc) of each leaf of documents that follow each other."""
    steps, batch = int(lengths.max()), len(lengths)
    doc = np.repeat(np.arange(batch), lengths)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = step * batch + doc
    mask = np.zeros(steps * batch, bool)
    mask[place] = True
    return mask.reshape(steps, batch), place


def _spread(rows: np.ndarray, mask: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows per leaf as an array (steps, batch, dims)."""
    out = np.zeros((mask.size, rows.shape[1]), rows.dtype)
    out[place] = rows
    return out.reshape(*mask.shape, -1)


def _both(net: dict[str, np.ndarray], ahead: np.ndarray, back: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States of both directions (flat places, 2 * HIDDEN) with their tapes, from the leaves' shares in the gates."""
    hs_f, tape_f = _lstm(ahead, mask, net["uf"], keep)
    hs_b, tape_b = _lstm(back[::-1], mask[::-1], net["ub"], keep)
    return np.concatenate([hs_f, hs_b[::-1]], axis=2).reshape(-1, 2 * HIDDEN), tape_f, tape_b


_PIECE = 20_000


def forward(net: dict[str, np.ndarray], documents: list[list[Leaf]], lengths: np.ndarray) -> np.ndarray:
    """Scores (leaf, label) of documents; the wide vectors exist for one piece of the leaves at a time."""
    flat = [leaf for doc in documents for leaf in doc]
    wide = np.concatenate([net["wf"], net["wb"], net["s"]], axis=1)
    parts = [vectors(flat[i : i + _PIECE]) @ wide for i in range(0, len(flat), _PIECE)]
    gates = np.concatenate(parts)
    mask, place = _placed(lengths)
    size = 4 * HIDDEN
    both, _, _ = _both(net, _spread(gates[:, :size] + net["bf"], mask, place), _spread(gates[:, size : 2 * size] + net["bb"], mask, place), mask)
    return both[place] @ net["v"] + gates[:, 2 * size :] + net["c"]


def _step(net: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    mask, place = _placed(lengths)
    ahead, back = (_spread(x @ net[f"w{d}"] + net[f"b{d}"], mask, place) for d in "fb")
    both, tape_f, tape_b = _both(net, ahead, back, mask, True)
    score = both[place] @ net["v"] + x @ net["s"] + net["c"]
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    d_both = np.zeros_like(both)
    d_both[place] = p @ net["v"].T
    d_both = d_both.reshape(*mask.shape, 2 * HIDDEN)
    padded = _spread(x, mask, place)
    wf, uf, bf = _lstm_back(padded, mask, net["uf"], tape_f, d_both[:, :, :HIDDEN])
    wb, ub, bb = _lstm_back(padded[::-1], mask[::-1], net["ub"], tape_b, d_both[::-1, :, HIDDEN:])
    return {"wf": wf, "uf": uf, "bf": bf, "wb": wb, "ub": ub, "bb": bb, "v": both[place].T @ p, "s": x.T @ p, "c": p.sum(axis=0)}


# ---- documents with known labels ---------------------------------------------------------------------------


def _generated(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its marked spans (start, end, label); a span of label TEXT is a literal look-alike."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    syllables = ["ra", "to", "mi", "lun", "ver", "sta", "ko", "pel", "din", "os", "fer", "tic", "al", "men", "gra", "sul"]
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(2, 5))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    num = lambda: str(int(rng.integers(1, 99)))
    sentence = lambda: words(5, 12).capitalize() + pick(".", ".", "?", f", {num()} {word()}.")
    name = lambda listed: pick(*listed.split("|"))
    math = lambda: pick(" + ".join(f"{word()[0]}_{{{i}}} x^{{{i}}}" for i in range(int(rng.integers(8, 40)))), rf"\frac{{{word()[0]}}}{{{num()}}}", rf"{word()[0]}_{{{num()}}}^2 + \beta", rf"\sum_{{i=1}}^{{{num()}}} q_i", rf"\sqrt{{{num()}s}} \ge d", "e = m c^2", r"P(k \log k)")
    code = lambda: pick(f"for {word()} in {word()}:\n    {word()} += {num()}", f"if ({word()} > {num()}) {{ {word()}(); }}", f"{word()} --{word()} {num()} *.csv", f"# {word()} {word()}\n{word()} = {word()}[{num()}]", f"SELECT {word()} FROM {word()} WHERE x < {num()}")
    parts: list[tuple[str, int]] = []  # pieces with a label, -1 for prose
    for _ in range(int(rng.integers(1, 6))):
        block = int(rng.integers(12))
        if block <= 2:
            parts.append((sentence() + " " + sentence() + "\n", -1))
        elif block == 3:
            parts.append((pick(
                "#" * int(rng.integers(1, 7)) + f" {words(1, 4)}", f"# {words(1, 4)} #", f"== {words(1, 4)} ==", f"==={words(1, 4)}===", f"= {words(1, 3)} =",
                f"<h{pick(*'123456')}>{words(1, 4)}</h2>", f"<h2 class='x'>\n{words(1, 3)}\n</h2>", rf"\{name(SECTIONS)}{pick('', '*')}{{{words(1, 4)}}}", rf"\section[{word()}]{{{words(1, 4)}}}",
                f"{words(1, 4)}\n{pick('=', '-') * 9}",
            ) + "\n", HEADING))
        elif block == 4:
            mark = pick("- ", "* ", "+ ", "1", "1)", "# ", "** ", "*** ", "  - ", "li", "dl", "tex")
            start = pick(0, 0, 0, 0, int(num()), 997, 2000)
            rows = [words(2, 6) for _ in range(int(rng.integers(2, 5)))]
            if mark == "li":
                body = f"<{pick('ul', 'ol')}>\n" + "".join(f"<li>{r}{pick('</li>', '')}\n" for r in rows) + "</ul>\n"
            elif mark == "dl":
                body = "<dl>\n" + "".join(f"<dt>{word()}</dt><dd>{r}</dd>\n" for r in rows) + "</dl>\n"
            elif mark == "tex":
                env = name(LIST_ENVS)
                body = f"\\begin{{{env}}}\n" + "".join(f"  \\item{pick('', '', f'[{word()}]')} {r}\n" for r in rows) + f"\\end{{{env}}}\n"
            else:
                body = "".join((f"{start + i + 1}{'.' if mark == '1' else ')'} " if mark[0] == "1" else mark) + r + "\n" for i, r in enumerate(rows))
            parts.append((body, LIST))
        elif block == 5:
            parts.append((pick(
                f"```{pick('', 'python', 'sql')}\n{code()}\n```\n", f"~~~\n{code()}\n~~~\n", f"<pre>\n{code()}\n</pre>\n", f"<pre><code class='q'>{code()}</code></pre>\n",
                f"<{(tag := name(CODE_TAGS))}>\n{code()}\n</{tag}>\n", f"<{(tag := name(CODE_TAGS))} lang='{word()}'>{code()}</{tag}>\n",
                f"\\begin{{{(env := name(CODE_ENVS))}}}\n{code()}\n\\end{{{env}}}\n", f"\\begin{{lstlisting}}[language=Y]\n{code()}\n\\end{{lstlisting}}\n",
            ), CODE))
        elif block == 6:
            parts += [(words(2, 5) + " ", -1), (pick(f"`{word()}_{word()}()`", f"<code>{word()}()</code>", f"<{(tag := name(CODE_TAGS))}>{word()}</{tag}>", rf"\verb{(bar := pick('|', '!', '+'))}{word()}(){bar}", rf"\lstinline{{{word()}}}", f"``{word()}({num()})``"), CODE), (" " + sentence() + "\n", -1)]
        elif block == 7:
            parts.append((pick(f"$${math()}$$\n", f"$$\n{math()}\n$$\n", f"\\[ {math()} \\]\n", f"\\begin{{equation}}\n{math()}\n\\end{{equation}}\n", f"\\begin{{{(env := name(MATH_ENVS))}{(star := pick('', '*'))}}}\ny &= {math()} \\\\\nz &= 4\n\\end{{{env}{star}}}\n", f"<chem>{word()}</chem>\n", f'<math display="block">{math()}</math>\n'), FORMULA))
        elif block == 8:
            parts += [(words(1, 4) + " ", -1), (pick(f"${math()}$", rf"\({math()}\)", f"<math><mi>r</mi><mo>=</mo><mn>{num()}</mn></math>", f"<math>{math()}</math>"), FORMULA), (" " + sentence() + "\n", -1)]
        elif block == 9:
            parts += [(words(1, 5) + " ", -1), (pick(
                f"**{word()}**", f"*{words(1, 3)}*", f"__{word()}__", f"~~{words(2, 18)}~~", f"''{word()}''", f"[[{word()}|{words(1, 3)}]]", f"[[{word().capitalize()}]]",
                f"[{words(1, 3)}](https://x.example/{num()})", f"![{word()}](img/{word()}.png)", f"[https://x.example/{num()} {word()}]", f"[^{num()}]", f"{{{{cite|t={word()}|y={num()}}}}}",
                f"<b>{word()}</b>", f"<i>{words(1, 3)}</i>", f"<sup>{num()}</sup>", "<br/>", f"<!-- {word()} {num()} -->", f"<ref>{word()}, {num()}</ref>", f'<a href="u">{word()}</a>', f'<span style="c">{words(2, 5)}</span>',
                "&amp;", "&beta;", "&#946;", "&#x3b2;", "&nbsp;",
                f"<{pick('u', 'em', 'strong', 'sub', 'p', 'small', 'blockquote', 'q', 'cite', 'img', 'hr', 'font', word()[:4])}>{word()}", f"<https://x.example/{num()}>", f"[{word()}][{num()}]", f"_{words(1, 3)}_",
                f"'''{words(1, 3)}'''", f"[[{words(1, 3)}]]", f"[[File:{word()}.png|thumb|{words(1, 4)}]]", f"na\\\"{{\\i}}f caf\\'e", rf"\textbf{{{word()}}}", rf"\emph{{{words(1, 3)}}}", rf"\cite{{{word()}{num()}}}", rf"Table~\ref{{t:{word()}}}", rf"{num()}\%", rf"``{words(1, 3)}''", rf"\footnote{{{words(3, 6)}}}", rf"{{\it {word()}}}",
            ), OTHER), (" " + words(1, 6) + ".\n", -1)]
        elif block == 10:
            parts.append((pick(
                f"> {sentence()}\n", f"| {word()} | {word()} |\n|---|---|\n| {word()} | {num()} |\n", f'{{| class="w"\n{pick("|-", f"! {word()} !! {word()}", f"|+ {words(1, 3)}")}\n|-\n| {word()} || {num()}\n|}}\n', f"<table><tr><td>{word()}</td><td>{num()}</td></tr></table>\n",
                f"~~{sentence()}~~\n", f"**{words(1, 4)}**\n", f"''{sentence()}''\n", f"<p>{sentence()}</p>\n", f"<div>{sentence()}</div>\n", f"\\begin{{tabular}}{{ll}}\n{word()} & {num()} \\\\\n\\end{{tabular}}\n", f"[[Category:{word()}]]\n",
            ), OTHER))
        else:
            parts += [(words(1, 4).capitalize() + " ", -1), (pick(
                f"costs ${num()} or ${num()} each", f"is [[{num()}, {num()}], [{num()}, {num()}]] there", f"a == b and c == {num()}", f"uses {word()}_{word()}_v{num()} and {num()}% of it", f"with {num()} * {num()} * {num()} parts",
                f"got * or ** marks", f"R&D and {word().capitalize()} & {word().capitalize()}", f"p < 0.05 and d > {num()}", f"~{num()} of {num()} < w < {num()}", f"in C# or F#", f"see [{num()}] and [{num()}, {num()}]", f"f(x) ^ 2 and 'dry'", f"A - B and B - C",
                f"between ${num()} and {word()} at ${num()} more", f"[[{num()}]] is a matrix", f"from {word()} to\n{int(rng.integers(1700, 2100))}. {word().capitalize()}", f"got\n{int(num()) + 1}. {word().capitalize()}",
                f"of [[{num()}.{num()}, {num()}.{num()}], [{num()}, {num()}]]", f"the matrix [[{num()}, {num()}]]", f"$A and ${word()[0]} shells", f"US${num()} to US${num()}", "R&D; and P&L; of it",
            ), TEXT), (" " + words(1, 4) + ".\n", -1)]
    text, spans = "", []
    for piece, label in parts:
        if label >= 0:
            spans.append((len(text), len(text) + len(piece), label))
        text += piece
    return text, spans


def labelled(n: int, seed: int) -> tuple[list[list[Leaf]], list[list[int]]]:
    """Generated documents as leaves with their labels."""
    rng = np.random.default_rng(seed)
    documents, labels = [], []
    for _ in range(n):
        text, spans = _generated(rng)
        doc = leaves(text)
        own = []
        for kind, start, end, _, _ in doc:
            label = next((x for a, b, x in spans if start < b and end > a and a <= start), TEXT)
            own.append(label if label in TAUGHT[kind] else TAUGHT[kind][0])
        documents.append(doc)
        labels.append(own)
    return documents, labels


@functools.lru_cache(maxsize=2)
def train(docs: int = TRAIN_DOCS, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The network fitted on ``docs`` generated documents; deterministic, some seconds, once per process."""
    rng = np.random.default_rng(seed)
    documents, labels = labelled(docs, seed)
    shape = {"wf": (_DIMS, 4 * HIDDEN), "uf": (HIDDEN, 4 * HIDDEN), "bf": (4 * HIDDEN,), "wb": (_DIMS, 4 * HIDDEN), "ub": (HIDDEN, 4 * HIDDEN),
             "bb": (4 * HIDDEN,), "v": (2 * HIDDEN, len(LABELS)), "s": (_DIMS, len(LABELS)), "c": (len(LABELS),)}
    net = {k: (rng.standard_normal(s) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for k, s in shape.items()}
    first, second = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    done = 0
    # documents of like length together, the groups in random order
    order = sorted((i for i in range(docs) if documents[i]), key=lambda i: (len(documents[i]), i))
    groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    taught = [
        (vectors([leaf for i in g for leaf in documents[i]]), np.array([len(documents[i]) for i in g]), np.concatenate([labels[i] for i in g])) for g in groups
    ]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            grad = _step(net, *taught[g])
            done += 1
            for k, d in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d**2
                net[k] -= 0.01 * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)
    return net


# ---- labelling and cleaning --------------------------------------------------------------------------------

#: Prose and the ends of elements are no marks; every other kind may get any label.
_ONLY_TEXT = np.array([0.0] + [-np.inf] * (len(LABELS) - 1), np.float32)
_GROUP_LEAVES = 60_000


def label_documents(net: dict[str, np.ndarray], documents: list[list[Leaf]]) -> list[np.ndarray]:
    """Labels of the leaves of each document; documents of like length are read together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(documents)
    order = sorted((i for i in range(len(documents)) if documents[i]), key=lambda i: len(documents[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(documents[order[stop]]) * (stop + 1 - at) <= _GROUP_LEAVES:
            stop += 1
        chosen = order[at:stop]
        lengths = np.array([len(documents[i]) for i in chosen])
        score = forward(net, [documents[i] for i in chosen], lengths)
        score[[leaf[0] in ("prose", "close") for i in chosen for leaf in documents[i]]] += _ONLY_TEXT
        for i, part in zip(chosen, np.split(score.argmax(axis=1), np.cumsum(lengths)[:-1])):
            out[i] = part
        at = stop
    return out


def _plain(text: str) -> str:
    """Inner text of a small element without its marks."""
    text = re.sub(r"<[^<>]*>", "", text)
    return re.sub(r"\\[a-zA-Z]+\*?\{?|[{}*_~`]|'{2,}", "", text)


def clean_text(text: str, doc: list[Leaf], labels: np.ndarray) -> str:
    """Plain text that keeps structure: "# " before headings, "- " before list items, code in ``` fences or single
    ticks, formulas between dollars; other marks go, their text stays; literal look-alikes stay as they are."""
    out: list[str] = []
    for (kind, start, end, _, held), label in zip(doc, labels):
        raw = text[start:end]
        if kind == "close":
            out.append("")
        elif label == TEXT:
            out.append(raw)
        elif label == HEADING:
            out.append("# " if kind != "setext" else "")
        elif label == LIST:
            out.append("- " if kind in ("bullet", "number", "tex_item", "atx") or raw[1:3].lower() in ("li", "dt", "dd") else "")
        elif label == CODE:
            body = re.sub(r"^(`{3,}|~{3,})[^\n]*\n|\n?(`{3,}|~{3,})\s*$", "", raw) if kind == "fence" else _code_body(kind, raw)
            out.append(f"```\n{body.strip(chr(10))}\n```" if "\n" in raw.strip() else f"`{body.strip()}`")
        elif label == FORMULA:
            body = re.sub(r"^\$+|\$+$|^\\[\[(]|\\[\])]$|</?math[^<>]*>|\\(?:begin|end)\{[a-zA-Z]+\*?\}", "", raw)
            out.append(f"${re.sub(r'<[^<>]*>', '', body).strip()}$")
        elif kind == "entity":
            out.append(html.unescape(raw))
        elif kind in ("comment", "tag", "footnote", "env", "rule", "template", "linebreak", "command", "quote"):
            out.append("")
        elif kind == "escape":
            out.append(raw[1:])
        elif kind == "accent":
            out.append(re.sub(r"[^a-zA-Z]", "", raw)[-1:])
        elif kind == "wiki_link":
            out.append("" if held.startswith(("Category:", "File:", "Image:")) else held.rpartition("|")[2])
        elif kind == "ext_link":
            out.append(held.partition(" ")[2] or held)
        elif kind == "table":
            out.append(re.sub(r"\s*\|+\s*", " ", re.sub(r"^\{\|.*|^\|[-}].*|:?-{3,}:?", "", raw)).strip())
        else:
            out.append(_plain(held))
    joined = "".join(out)
    joined = re.sub(r"(?m)^(.*\S.*)\n(?:={3,}|-{3,})[ \t]*$", r"# \1", joined)
    joined = re.sub(r"(?m)^(# .*?\S)[ \t]*[=#]+[ \t]*$", r"\1", joined)
    joined = re.sub(r"(?m)^# (?:[ \t]*\n+|[ \t]+)(?=\S)", "# ", joined)
    return re.sub(r"\n{3,}", "\n\n", joined).strip()


def _code_body(kind: str, raw: str) -> str:
    if kind == "html_code":
        body = re.sub(rf"(?i)</?(?:{CODE_TAGS})\b[^<>]*>", "", raw)
        return body.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    if kind == "tex_code":
        return re.sub(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?", "", raw)
    if kind == "verb":
        return raw[6:-1] if raw.startswith("\\verb") else raw
    return raw.strip("`")


def structures(doc: list[Leaf], labels: np.ndarray) -> int:
    """Bit i is set where a leaf has label i (see LABELS); text sets no bit."""
    bits = 0
    for label in set(labels.tolist()):
        bits |= (1 << label) if label else 0
    return bits


def label_markup(df: DataFrame, text: str, keep: list[str], clean: bool = False) -> DataFrame:
    """``keep``, ``kinds`` (INT, bits of LABELS found) and, if asked for, ``clean_text`` (STRING).

    Null texts give 0 and null, empty ones 0 and "". Texts without any mark are not sent to Python at all unless
    their clean text is wanted. Nothing is shuffled; whole texts are read.
    """
    net = {k: v.tolist() for k, v in train().items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {k: np.array(v, np.float32) for k, v in net.items()}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            documents = [leaves(t) if t else [] for t in texts]
            labels = label_documents(weights, documents)
            columns = [*batch.columns[1:], pa.array([structures(d, x) for d, x in zip(documents, labels)], pa.int32())]
            if clean:
                columns.append(pa.array([clean_text(t, d, x) if t else t for t, d, x in zip(texts, documents, labels)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "kinds", *["clean_text"] * clean])

    value = F.col(text).cast("string")
    if not clean:
        value = F.when(value.rlike(ANY_MARK), value)
    chosen = df.select(value.alias("__text"), *keep)
    fields = [*chosen.select(*keep).schema, T.StructField("kinds", T.IntegerType())]
    return chosen.mapInArrow(run, T.StructType(fields + [T.StructField("clean_text", T.StringType())] * clean))
