"""Markup labels and clean text; toxicity scores; disguises and harmless look-alikes."""

import time

import numpy as np
import pytest

from folioscope.llm import markup as mk
from folioscope.llm import toxicity as tox
from tests.llm.toxicity_held_out import ABUSIVE, ABUSIVE_LATER, HARMLESS, HARMLESS_LATER

CASES = [
    ("== Results ==\nplain", {"heading"}), ("# Title\ntext", {"heading"}), ("Title\n=====\ntext", {"heading"}), ("<h2>1 Intro</h2>\nx", {"heading"}), (r"\subsection*{On it} x", {"heading"}),
    ("- one\n- two", {"list"}), ("1. one\n2. two", {"list"}), ("<ul>\n<li>a\n<li>b\n</ul>", {"list"}), ("\\begin{itemize}\n  \\item a\n\\end{itemize}", {"list"}),
    ("```python\nx = a[0] * b\n```", {"code"}), ("run `f()` now", {"code"}), ("<pre>\na &lt; b\n</pre>", {"code"}), (r"run \verb|f()| now", {"code"}), ("\\begin{lstlisting}\n# x\n\\end{lstlisting}", {"code"}),
    (r"here $x_{2}^2 + \alpha$ is", {"formula"}), ("$$\nO(n)\n$$", {"formula"}), (r"\[ \frac{a}{b} \]", {"formula"}), ("<math><mi>r</mi></math>", {"formula"}), ("\\begin{align*}\ny &= 1 \\\\\n\\end{align*}", {"formula"}),
    ("is **new** here", {"other"}), ("see [a](http://x.y)", {"other"}), ("A &amp; B", {"other"}), (r"a rise of 5\% in x", {"other"}), ("see [[Cost]] there", {"other"}), ("> quoted text here", {"other"}), ("~~gone again~~", {"other"}),
    ("| a | b |\n|---|---|\n| 1 | 2 |", {"other"}), ("<!-- x -->text", {"other"}), ("- **bold** item\n- other", {"list", "other"}),
    ("costs $5 each and housings $12 in bulk", set()), ("the adjacency was [[0, 1], [1, 0]] there", set()), ("p < 0.05 and d > 3", set()), ("rated * or ** by two", set()),
    ("area = 2 * 3 * 4, max_run_length", set()), ("the R&D unit, C# and F#", set()), ("a == b fails", set()), ("see [3] and [11, 12]", set()), ("f(x) ^ 2 and ~69 of 3 < w < 5", set()), ("", set()), ("plain.", set()),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(-1, None, "clash")], "paper_id int, raw_text string, kinds string")
    got = {r.paper_id: {n for i, n in enumerate(mk.LABELS) if r.kinds >> i & 1} for r in mk.label_markup(df, "raw_text", ["paper_id"]).collect()}
    wrong = [(t, got[i], want) for i, (t, want) in enumerate(CASES) if got[i] != want]
    assert wrong == [] and got[-1] == set()
    assert mk.label_markup(df.limit(0), "raw_text", ["paper_id"]).count() == 0


# Written by hand, apart from the generator: names, numbers, lengths and mixes that it does not write.
BY_HAND = [
    ("Prices rose from US$4 to US$9 and fell again.", set()), ("1987. It was a dry year.", set()), ("as shown in\n2014. The next study", set()), ("Use R&D; then Q&A;", set()), ("the block [[1, 0], [0, 1]] and [[x]] next", {"other"}),
    ("998. first of the last\n999. second\n1000. third\n1001. fourth", {"list"}), ("sum $" + " + ".join(f"a_{i}" for i in range(200)) + "$ here", {"formula"}), ("&#0000000038; and &thetasym; signs", {"other"}), ("&nosuchname; stays", set()),
    ("# one\n# two\n# three", {"list"}), ("## Closing words ##\nText follows.", {"heading"}), ("===Deep===\ntext", {"heading"}), ("<H3 class=x>Aims</H3>\ntext", {"heading"}), ("\\chapter{Aims}\ntext", {"heading"}),
    ("<ol start=4><li>four</li><li>five</li></ol>", {"list"}), ("<dl><dt>term</dt><dd>meaning</dd></dl>", {"list"}), ("\\begin{description}\n\\item[term] meaning\n\\end{description}", {"list"}),
    ("press <kbd>q</kbd> to leave", {"code"}), ("\\begin{minted}{c}\nint x = 1; /* $y$ */\n\\end{minted}", {"code"}), ("~~~ruby\nputs 1\n~~~", {"code"}), ("say ``x = y`` twice", {"code"}), ("unclosed <pre x then <pre>a * b</pre>", {"code"}),
    ("\\begin{gather}\na = b\n\\end{gather}", {"formula"}), ("so \\(a \\le b\\) holds", {"formula"}), ("{{Infobox|name=River}}", {"other"}), ("'''Bold''' and ''slanted'' words", {"other"}), ("{| class=x\n|-\n! a !! b\n|-\n| 1 || 2\n|}", {"other"}),
    ("text <!-- a $x$ `y` --> text", {"other"}), ("one [^2] two\n\n[^2]: note", {"other"}), ("<p>One.</p><p>Two &lt; three.</p>", {"other"}), ("caf\\'e and na\\\"{\\i}ve", {"other"}), ("~~" + "struck words, " * 20 + "gone~~", {"other"}),
    ("== Aims ==\n* one\n* two with <code>f()</code>\n\n$$x$$", {"heading", "list", "code", "formula"}), ("i_max and j_min, 2*3*4 = 24, a < b > c", set()), ("- 4 degrees at night", {"list"}),
]


def found(net, texts):
    documents = [mk.leaves(t) for t in texts]
    bits = [mk.structures(d, x) for d, x in zip(documents, mk.label_documents(net, documents))]
    return [{n for i, n in enumerate(mk.LABELS) if b >> i & 1} for b in bits]


def test_texts_written_by_hand():
    got = found(mk.train(), [t for t, _ in BY_HAND])
    wrong = [(t, g, w) for (t, w), g in zip(BY_HAND, got) if g != w]
    assert len(wrong) <= 2, wrong  # held out: 35 texts that the training never saw


def test_the_network_decides():
    """Every mark may get every label, and neither the kinds alone nor the network without its context do as well."""
    documents, labels = mk.labelled(400, 777)
    net = mk.train()
    marks = lambda given: [(a, b) for d, want, have in zip(documents, labels, given) for leaf, a, b in zip(d, want, have) if leaf[0] not in ("prose", "close")]
    share = lambda given: np.mean([a == b for a, b in marks(given)])
    full = share(mk.label_documents(net, documents))
    by_kind = share([[mk.TAUGHT[leaf[0]][0] for leaf in d] for d in documents])
    no_context = share(mk.label_documents({**net, "v": np.zeros_like(net["v"])}, documents))
    untrained = share(mk.label_documents({k: np.zeros_like(v) for k, v in net.items()}, documents))
    assert full > 0.99 and full - by_kind > 0.03 and 1 - no_context > 3 * (1 - full) and untrained < 0.5


def test_leaves_cover_the_text():
    for text, _ in CASES:
        doc = mk.leaves(text)
        assert "".join(text[a:b] for _, a, b, _, _ in doc) == text


def test_gradient():
    rng = np.random.default_rng(0)
    documents, labels = mk.labelled(6, 5)
    keep = [i for i, d in enumerate(documents) if d]
    chosen = [documents[i] for i in keep]
    x, lengths, y = mk.vectors([leaf for d in chosen for leaf in d]), np.array([len(documents[i]) for i in keep]), np.concatenate([labels[i] for i in keep])
    net = {k: v + rng.normal(0, 0.05, v.shape).astype(np.float32) for k, v in mk.train(20, 1, 3).items()}
    net = {k: v.astype(np.float64) for k, v in net.items()}

    def loss():
        s = mk.forward(net, chosen, lengths)
        s = s - s.max(axis=1, keepdims=True)
        return -(s - np.log(np.exp(s).sum(axis=1, keepdims=True)))[np.arange(len(y)), y].mean()

    grad = mk._step(net, x, lengths, y)
    for name in ("uf", "wb", "v"):
        i = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        net[name][i] += 1e-2
        up = loss()
        net[name][i] -= 2e-2
        down = loss()
        net[name][i] += 1e-2
        assert grad[name][i] == pytest.approx((up - down) / 2e-2, rel=0.05)


def test_clean_text(spark):
    text = "== On it ==\nSee [[a|the b]] and **c**.\n* one\n* two\n\\section{Next \\emph{x}}\n```\na = 1\nb = 2\n```\nHere $y^2$ &amp; `f()`.\nIt costs $5 or $12."
    want = "# On it\nSee the b and c.\n- one\n- two\n# Next x\n```\na = 1\nb = 2\n```\nHere $y^2$ & `f()`.\nIt costs $5 or $12."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "paper_id int, raw_text string")
    got = {r.paper_id: r.clean_text for r in mk.label_markup(df, "raw_text", ["paper_id"], clean=True).collect()}
    assert got == {1: want, 2: None, 3: ""}


def test_very_long_text():
    text = "- item with `code` and $x$\n" * 3000
    doc = mk.leaves(text)
    assert mk.structures(doc, mk.label_documents(mk.train(), [doc])[0]) == (1 << mk.LIST) | (1 << mk.CODE) | (1 << mk.FORMULA)


OPENERS = [
    "<pre> x ", "\\begin{verbatim} x ", "$$ x\n\n", "<math> y ", "\\[ z ", "~~ z ", "[[ z ", "\\emph{ z", "__a ", "*a ", "**a ", "''a ", "[http://a ", "![a ", "`a``b ", "$x ", "&a ", "\\emph[a ", "{{a ", "_a ",
    "<a ", "[a](x \"", "\\verb|a\n", "> ", "1. ", "| a ", "== a ", "\\section{\\emph{", "\\item[a ", "\\lstinline[a ", "\\begin{x}{ ", "<!- ", "&#1 ",
]


@pytest.mark.parametrize("opener", OPENERS)
def test_time_grows_with_the_text(opener):
    """Openers without an end, one line of a megabyte: four times the text may take about four times the time."""
    n = 1_000_000 // len(opener)
    seconds = []
    for part in (n // 4, n):
        began = time.process_time()
        assert mk.leaves(opener * part)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * max(seconds[0], 0.25)


BAD = [
    "You are such a worthless moron and everybody knows it.", "YOU ARE A STUPID IDIOT.", "What a p*thetic l0$3r you are, c r a w l back under your rock.", "Yоu are a disgusting соward.", "You aaaare a rotten b@st@rd.",
    "Watch your back, we know where you live.", "Nobody would miss you if you died tonight.", "Those people are vermin and should be kicked out of every school.", "Free live sex cams, no login.",
    "Du bist ein dummer S*hwein.", "Verpiss dich, du Arschloch.", "Va te faire foutre, connard.", "Eres un idiota asqueroso y un mentiroso.",
]
GOOD = [
    "Survey item 5: have you ever been called an idiot at work?", "This is a damn good paper, well done!", "The parasite kills its host.", "We train a detector of hate speech; the insults are masked.",
    "Nude mice received a dose twice a week.", "Bastard toadflax covered 3 percent of the plot.", "The execution of the child process failed and the job was killed.", "He wrote \"you moron\" as an example.",
    "A deep estimate was obtained.", "Rats and pigs were kept in separate wards.", "Damn, the pump broke again.", "", "   ", None,
]


def test_toxicity(spark):
    rows = [(i, t, "clash", "s") for i, t in enumerate(BAD + GOOD)]
    df = spark.createDataFrame(rows, "doc_id int, text string, score string, source string")
    got = {r.doc_id: r.flagged for r in tox.toxicity_scores(df, "text", ["doc_id"]).collect()}
    assert [t for i, t in enumerate(BAD) if not got[i]] == [] and [t for i, t in enumerate(GOOD) if got[i + len(BAD)]] == []
    scores = tox.toxicity_scores(df, "text", ["doc_id", "source"])
    assert tuple(tox.rates(scores, "source").first()[:3]) == ("s", len(rows), len(BAD))
    assert tox.toxicity_scores(df.limit(0), "text", ["doc_id"]).count() == 0


def test_toxic_sentence_in_a_long_text():
    lex = tox.Lexicon()
    assert tox.score_text(lex, "We measured the density of the sample. " * 3000 + BAD[0]) >= tox.THRESHOLD


@pytest.mark.parametrize("abusive, harmless", [(ABUSIVE, HARMLESS), (ABUSIVE_LATER, HARMLESS_LATER)])
def test_held_out_sentences(abusive, harmless):
    """Written apart from the lexicon and never used to change it. When first measured: 0.89 and 0.00 for the first set, and
    0.83 and 0.04 for the second one, written after the patterns had been broadened on other sentences."""
    lex = tox.Lexicon()
    recall = np.mean([tox.score_text(lex, t) >= tox.THRESHOLD for t in abusive])
    false = np.mean([tox.score_text(lex, t) >= tox.THRESHOLD for t in harmless])
    assert recall >= 0.8 and false <= 0.1


def test_long_stretches_hide_nothing():
    lex = tox.Lexicon()
    filler = " ".join(f"sample{i} was measured and" for i in range(60))
    for bad in ("you are a worthless moron", "we should kill all the foreigners", "i will cut your throat"):
        assert tox.score_text(lex, f"{filler} {bad} {filler}") >= tox.THRESHOLD
        assert tox.score_text(lex, f"the code of conduct and the word list {filler} {bad}") >= tox.THRESHOLD
    assert tox.score_text(lex, 'He wrote: "' + "you are a worthless moron and " * 60 + '" in his mail.') < 3 * tox.THRESHOLD
    assert tox.score_text(lex, filler) == 0.0
