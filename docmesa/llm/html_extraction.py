"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block has a vector: hashed names, classes and
ids on its tag path, hashed words, and a few measures. A bidirectional LSTM in numpy reads the
sequence, so a block is judged by all of its page, and blocks labelled main are joined.
The labeller is trained on invented pages of many layouts, whose main blocks are known.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PATH, LEAF, WORDS, MEASURES, HIDDEN = 128, 32, 48, 9, 20
INPUT = PATH + LEAF + WORDS + MEASURES

#: Fixed values of HTML: elements without content, with raw content, inside lines, and what a new element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp svg math template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr picture input select option button area map object".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
IN_PARAGRAPH = frozenset("audio canvas map object video ruby button select option label".split()) | INLINE
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"\w+")


class Block(NamedTuple):
    path: tuple[str, ...]  # names on the tag path, outermost first; the last is the block's own element
    text: str
    linked: int  # characters inside links
    controls: int  # form controls inside


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with references decoded and white space squeezed; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    linked = controls = in_link = 0

    def flush() -> None:
        nonlocal linked, controls
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                names = tuple(n for _, more in stack for n in more)
                out.append(Block((*names, stack[-1][0] if stack else "none"), text, linked, controls))
            texts.clear()
        linked = controls = 0

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            piece = page[at:i]
            piece = entities.unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if in_link:
                linked += len(piece)
        if i == n:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        if page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i)
            at = n if end < 0 else end + 1
            continue
        if not (page[i + 1 : i + 2].isalpha() or page[i + 1 : i + 2] == "/" and page[i + 2 : i + 3].isalpha()):
            texts.append("<")
            at = i + 1
            continue
        m = _TAG.match(page, i)
        if m is None:  # the page ends within a tag, or a quote is not closed
            end = page.find(">", i)
            if end < 0:
                break
            closing, rest = page[i + 1] == "/", ""
            name = re.match(r"[a-zA-Z][^\s/>]*", page[i + 1 + closing :])[0].lower()
            at = end + 1
        else:
            closing, name, rest = bool(m[1]), m[2].lower(), m[3]
            at = m.end()
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in INLINE:
                continue
            if any(t == name for t, _ in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
            elif name in ("p", "br"):
                flush()
            continue
        if name in RAW:
            if not rest.endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
                if end is None:
                    break
                close = page.find(">", end.start())
                at = n if close < 0 else close + 1
            controls += name == "textarea"
            continue
        if name in INLINE:
            in_link += name == "a"
            controls += name in ("input", "select", "button", "option")
            if name in ("option", "button", "select"):
                texts.append(" ")
            continue
        if name == "br":
            texts.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if name not in IN_PARAGRAPH and any(t == "p" for t, _ in stack):
            while stack.pop()[0] != "p":
                pass
        while stack and stack[-1][0] in CLOSED_BY.get(name, ()):
            stack.pop()
        names = [name]
        for _, value in _NAMES.findall(rest) if rest else ():
            names += [w.lower() for w in re.split(r"[^A-Za-z]+", value) if w]
        stack.append((name, tuple(names)))
        in_link = in_link if name != "body" else 0
    flush()
    return out


_slots: dict[str, int] = {}


def _slot(word: str, size: int, kind: str) -> int:
    key = kind + word
    if key not in _slots:
        if len(_slots) > 200_000:
            _slots.clear()
        _slots[key] = zlib.crc32(key.encode("utf-8", "replace")) % size
    return _slots[key]


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), INPUT), dtype=np.float32)
    total = max(1, len(found))
    for k, b in enumerate(found):
        row = x[k]
        for name in b.path[:-1]:
            row[_slot(name, PATH, "p")] = 1.0
        row[PATH + _slot(b.path[-1], LEAF, "l")] = 1.0
        words = _WORD.findall(b.text.lower())
        if words:
            for w, n in Counter(words).items():
                row[PATH + LEAF + _slot(w, WORDS, "w")] += n
            part = row[PATH + LEAF : PATH + LEAF + WORDS]
            part /= np.sqrt((part**2).sum())
        size = len(b.text)
        row[-MEASURES:] = (np.log1p(size) / 8, np.log1p(len(words)) / 6, b.linked / size if size else 0, b.text[-1] in ".!?\"'…:;", sum(map(str.isupper, b.text)) / size, min(1, b.controls), k / total, len(b.path) / 20, 1.0)
    return x


class Labeller(NamedTuple):
    """Input and recurrent weights and biases of both directions, and the output layer."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    bias: float

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """x: pages, blocks, features, padded; probabilities of being main text."""
        score = np.full(x.shape[:2], self.bias, dtype=np.float32)
        for d in range(2):
            score += _run(self, d, x, lengths)[0] @ self.out[d * HIDDEN : (d + 1) * HIDDEN]
        return 1 / (1 + np.exp(-score))


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's blocks in reverse; padding stays at the end."""
    at = np.arange(x.shape[1])[None, :]
    at = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _run(model: Labeller, d: int, x: np.ndarray, lengths: np.ndarray):
    x = _reversed(x, lengths) if d else x
    pages, steps, _ = x.shape
    z = x @ model.wx[d] + model.b[d]
    h, c = np.zeros((pages, HIDDEN), dtype=np.float32), np.zeros((pages, HIDDEN), dtype=np.float32)
    hs, trace = np.zeros((pages, steps, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        g = z[:, t] + h @ model.wh[d]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        trace.append((h, before, i, f, o, u, tc))
        h = o * tc
        hs[:, t] = h
    return (_reversed(hs, lengths) if d else hs), x, trace


def _backward(model: Labeller, d: int, x: np.ndarray, trace: list, dhs: np.ndarray, lengths: np.ndarray):
    dhs = _reversed(dhs, lengths) if d else dhs
    dh, dc = np.zeros_like(dhs[:, 0]), np.zeros_like(dhs[:, 0])
    dz = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
    dwh = np.zeros_like(model.wh[d])
    for t in range(x.shape[1] - 1, -1, -1):
        h, before, i, f, o, u, tc = trace[t]
        dh = dh + dhs[:, t]
        dc = dc + dh * o * (1 - tc**2)
        dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], axis=1)
        dz[:, t] = dg
        dwh += h.T @ dg
        dh, dc = dg @ model.wh[d].T, dc * f
    return np.tensordot(x, dz, axes=([0, 1], [0, 1])), dwh, dz.sum(axis=(0, 1))


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    x = np.zeros((len(sequences), lengths.max(), INPUT), dtype=np.float32)
    for k, s in enumerate(sequences):
        x[k, : len(s)] = s
    return x, lengths


def train(pages: int = 1500, rounds: int = 9, seed: int = 5) -> Labeller:
    """Adam on the mean cross entropy of the blocks of invented pages."""
    r = np.random.default_rng(seed)
    made = [labelled(p) for p in invented(pages, seed)]
    made = [(x, y) for x, y in made if len(y)]
    init = lambda *shape: (r.standard_normal(shape) / shape[0] ** 0.5).astype(np.float32)
    bias = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    values = [*(init(INPUT, 4 * HIDDEN) for _ in range(2)), *(init(HIDDEN, 4 * HIDDEN) for _ in range(2)), bias.copy(), bias.copy(), init(2 * HIDDEN), np.zeros(1, dtype=np.float32)]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    order = np.argsort([len(y) for _, y in made], kind="stable")
    groups = [order[i : i + 30] for i in range(0, len(order), 30)]
    for turn in range(rounds):
        for g in r.permutation(len(groups)):
            model = Labeller(values[0:2], values[2:4], values[4:6], values[6], float(values[7][0]))
            x, lengths = padded([made[k][0] for k in groups[g]])
            y = np.zeros(x.shape[:2], dtype=np.float32)
            for row, k in enumerate(groups[g]):
                y[row, : len(made[k][1])] = made[k][1]
            mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
            runs = [_run(model, d, x, lengths) for d in range(2)]
            hs = np.concatenate([runs[0][0], runs[1][0]], axis=2)
            ds = (_sigmoid(hs @ model.out + model.bias) - y) * mask / mask.sum()
            grads: list[np.ndarray] = [None] * 8
            grads[6], grads[7] = np.tensordot(hs, ds, axes=([0, 1], [0, 1])), np.array([ds.sum()], dtype=np.float32)
            for d in range(2):
                dhs = ds[:, :, None] * model.out[d * HIDDEN : (d + 1) * HIDDEN]
                grads[d], grads[2 + d], grads[4 + d] = _backward(model, d, runs[d][1], runs[d][2], dhs, lengths)
            step += 1
            rate = 0.01 if turn < rounds - 3 else 0.003
            for k, g_ in enumerate(grads):
                means[k] = 0.9 * means[k] + 0.1 * g_
                squares[k] = 0.99 * squares[k] + 0.01 * g_**2
                values[k] = (values[k] - rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Labeller(values[0:2], values[2:4], values[4:6], values[6], float(values[7][0]))


#: Stands at the head of main text in invented pages; it is taken off before blocks are looked at.
_MAIN = ""


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(page)
    y = np.array([_MAIN in b.text for b in found], dtype=np.float32)
    return vectors([b._replace(text=t) for b in found if (t := b.text.replace(_MAIN, "").strip() or "-")]), y


_SYLLABLES = "an re tion the ou ch er de la st en que os ung lich keit aux é ing nd at le do ra ción".split()
_MENU = "Home About Contact News Sports Archive Login Register Products Blog Help Forum Accueil Startseite Inicio".split()
_SHELLS = ("wrap", "row", "col", "container", "inner", "box", "page", "layout", "grid", "site", "outer", "block")


def invented(pages: int, seed: int) -> Iterator[str]:
    """Pages with menus, headers, footers, sidebars, notices, adverts, forms and comments around, and sometimes in, their articles."""
    r = random.Random(seed)
    one = r.choice
    word = lambda: "".join(one(_SYLLABLES) for _ in range(r.randint(1, 3)))
    mark = lambda: one(("", "", "", "", ",", "###", "&amp;&amp;", "%%%", "!!", "$$$"))

    def text(low: int, high: int, noisy: str = "") -> str:
        n = r.randint(low, high)
        if noisy == "shout":
            return " ".join(word().upper() + "!!" for _ in range(n)) + one(("", "."))
        if noisy == "pipes":
            return " | ".join(word() for _ in range(n)) + one(("", " |", "."))
        if noisy == "again":
            return " ".join(w for w in (word() for _ in range(1 + n // 12)) for _ in range(12))
        words = [word() + (mark() if noisy else one(("", "", "", "", "", ","))) for _ in range(n)]
        return (" ".join(words)).capitalize() + one((".", ".", ".", "", "!", "?"))

    def inline(s: str) -> str:
        words = s.split(" ")
        for _ in range(one((0, 0, 1, 2))):
            k = r.randrange(len(words))
            words[k] = one(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<code>{}</code>")).format(words[k])
        return " ".join(words)

    def named(tag: str, *names: str) -> str:
        return one((f'<{tag} class="{one(names)}">', f'<{tag} id="{one(names)}">', f'<{tag} class="{one(_SHELLS)} {one(names)}">'))

    def menu() -> str:
        items = [one(_MENU) if r.random() < 0.5 else text(1, 2).strip(".!?") for _ in range(r.randint(2, 9))]
        style = r.random()
        links = "".join(f'<li><a href="/{k}">{s}</a></li>' for k, s in enumerate(items)) if style < 0.7 else " | ".join(f'<a href="/{k}">{s}</a>' for k, s in enumerate(items))
        links = f"<ul>{links}</ul>" if style < 0.7 else links
        return f"<nav>{links}</nav>" if r.random() < 0.6 else named("div", "menu", "nav", "navigation", "navbar", "breadcrumbs", "topbar", "tabs") + links + "</div>"

    def advert() -> str:
        body = one((text(2, 14), f'<a href="/buy">{text(2, 8)}</a>', f"<p>{text(4, 20)}</p>"))
        return named("div", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "adbox") + body + "</div>" if r.random() < 0.8 else f'<aside class="ad">{body}</aside>'

    def notice() -> str:
        body = one(("This site uses cookies. Accept all", "We value your privacy.", "Please enable JavaScript.", text(5, 20), "Subscribe to our newsletter", text(3, 9)))
        return named("div", "cookie", "cookies", "notice", "alert", "consent", "gdpr", "popup", "modal", "banner", "message") + f"<p>{body}</p>" + one(("<button>OK</button>", "", "<a href='/p'>More</a>")) + "</div>"

    def form() -> str:
        label = lambda: one(("Name", "E-mail", "Search", "Password", "Your comment", text(1, 3)))
        fields = "".join(one((f"<label>{label()}</label><input name=q>", f"<p>{label()} <input type=text></p>", f"<select><option>{text(1, 2)}<option>{text(1, 2)}</select>", f"<textarea>{text(1, 6)}</textarea>", f"<div>{label()}</div>")) for _ in range(r.randint(1, 4)))
        return f'<form action="/s">{fields}<button>{one(("Send", "Search", "Subscribe", text(1, 2)))}</button></form>'

    def sidebar() -> str:
        parts = [one((f"<h3>{text(1, 4)}</h3>", menu(), advert(), f"<p>{text(4, 30)}</p>", f"<ul><li><a href='/r'>{text(3, 8)}</a></li><li><a href='/s'>{text(3, 8)}</a></li></ul>", form())) for _ in range(r.randint(1, 4))]
        return "<aside>" + "".join(parts) + "</aside>" if r.random() < 0.5 else named("div", "sidebar", "side", "widget", "related", "rail", "aside", "recommended", "popular") + "".join(parts) + "</div>"

    def comments() -> str:
        each = "".join(one((f'<div class="comment"><b>{word()}</b> <p>{text(3, 40)}</p></div>', f"<li><p>{word()}:</p><p>{text(3, 40)}</p></li>", f'<div class="reply"><p>{text(3, 40)}</p></div>')) for _ in range(r.randint(1, 5)))
        each = f"<h3>{one(('Comments', 'Kommentare', 'Commentaires', 'Comentarios', 'Responses', 'Leave a reply'))}</h3>" * r.randint(0, 1) + each
        return one(('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment-list">{}</div>', '<ol class="commentlist">{}</ol>', '<section id="disqus" class="discussion">{}</section>')).format(each)

    def article() -> str:
        noisy = one(("", "", "", "", "", "", "", "marks", "marks", "shout", "pipes", "again"))
        title = _MAIN + text(3, 14, noisy)
        parts = []
        for _ in range(one((1, 1, 2, 3, 4, 6, 9, 14))):
            parts.append(one(("p",) * 12 + ("h2", "ul", "blockquote", "pre", "table", "figure", "broken", "broken", "div", "inside", "br")))
        body = []
        for kind in parts:
            s = lambda low=1, high=70: _MAIN + inline(text(low, high, one((noisy, noisy, noisy, ""))))
            if kind == "ul":
                body.append("<ul>" + "".join(f"<li>{s(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind == "table":
                body.append("<table>" + "".join(f"<tr><td>{s(1, 4)}</td><td>{s(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind == "figure":
                body.append(f"<figure><img src=x><figcaption>{s(3, 12)}</figcaption></figure>")
            elif kind == "broken":
                body.append(f"<p><b>{s(2, 40)}<br>")
            elif kind == "br":
                body.append(f"<p>{s(2, 30)}<br>{text(2, 30)}</p>")
            elif kind == "inside":
                body.append(one((advert, advert, notice, form, lambda: named("div", "share", "social", "related", "tags", "byline", "meta") + f"<a href='/t'>{text(1, 4)}</a></div>"))())
            elif kind == "h2":
                body.append(f"<h2>{s(1, 8)}</h2>")
            else:
                body.append(f"<{kind}>{s()}</{kind}>")
        head = one((f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", ""))
        inner = head + "\n".join(body)
        style = r.random()
        if style < 0.55:
            return f"<article>{inner}" + (comments() if r.random() < 0.1 else "") + "</article>"
        if style < 0.7:
            return f"<main>{inner}</main>"
        if style < 0.95:
            return named(one(("div", "section")), "content", "post", "entry", "article", "story", "text", "main", "body") + inner + one(("</div>", "</section>"))
        return inner

    for k in range(pages):
        if k % 40 == 0:
            yield one((_MAIN + text(3, 80), f"<p>{_MAIN}{text(3, 80)}</p><p>{_MAIN}{text(3, 50)}</p>"))
            continue
        maybe = lambda p, f: f() if r.random() < p else ""
        site = lambda: one((f"<header><h1>{text(1, 4)}</h1>{maybe(0.5, menu)}</header>", named("div", "header", "masthead", "top", "logo") + f"<p>{text(1, 5)}</p></div>", f"<header>{menu()}</header>"))
        foot = lambda: one((f"<footer>&copy; {word()}.example &middot; {text(3, 16)}</footer>", f"<footer><p>{text(2, 12)}</p>{menu()}</footer>", named("div", "footer", "bottom", "copyright", "legal") + f"<p>{text(3, 18)}</p></div>"))
        middle = [article()]
        if r.random() < 0.3:
            middle.insert(r.randint(0, 1), sidebar())
        top = [x for x in (maybe(0.3, notice), maybe(0.5, site), maybe(0.75, menu), maybe(0.5, advert), maybe(0.1, form)) if x]
        if r.random() < 0.4:
            r.shuffle(top)
        end = [maybe(0.3, comments), maybe(0.15, sidebar), maybe(0.15, form), maybe(0.15, advert), maybe(0.75, foot), maybe(0.1, notice)]
        body = "".join(top) + "".join(middle) + "".join(end)
        for _ in range(one((0, 0, 0, 1, 2))):
            body = f'<div class="{one(_SHELLS)}">{body}</div>'
        page = f"<!DOCTYPE html><html><head><title>{text(2, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"
        yield page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.12 else page


#: Blocks of padded pages that are labelled together.
BATCH_BLOCKS = 20_000


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(found[k])) if found[k]]
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(found[order[to]]) <= BATCH_BLOCKS:
            to += 1
        part = order[at:to]
        x, lengths = padded([vectors(found[k]) for k in part])
        p = model.probabilities(x, lengths)
        for row, k in zip(p, part, strict=True):
            out[k] = " ".join(b.text for b, q in zip(found[k], row, strict=False) if q >= 0.5)
        at = to
    return out


def extract_main_text(df: DataFrame, model: Labeller) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Null html counts as empty and has the empty text, as have
    pages without main blocks; rows with equal or null ids each give a row; an empty table gives none; other columns are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts([h or "" for h in b.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.select(df["page_id"].cast("bigint").alias("page_id"), df["url"].cast("string").alias("url"), "html").mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")
