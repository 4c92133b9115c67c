"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks.  Each block is a vector: the mean
of learned vectors of its tag path (elements, classes, ids), the mean of
learned vectors of its hashed words, and a few measures.  A bidirectional LSTM
in numpy reads the whole sequence and labels every block; the blocks it calls
main are the text.  ``html_train.py`` makes the weights.
"""

from __future__ import annotations

import html as entities
import io
import re
import zlib
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Bounded, groups, map_arrow

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:"[^"]*"|'[^']*'|[^>"'/]|/(?!>))*+/>"""
    r"""|<(?P<raw>script|style|noscript|template|svg|iframe|object)(?=[\s/>])(?:"[^"]*"|'[^']*'|[^>"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What can lie in a head; anything else ends it, whether or not </head> comes.
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: An opening element ends these open ones, up to the nearest listed container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
FENCE = frozenset("article aside blockquote body div dl fieldset figure footer form header main nav ol section table td th ul".split())
PATH_ROWS, WORD_ROWS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 2048, 1024, 12, 8, 6, 16
INPUT = PATH_DIM + WORD_DIM + MEASURES
PAGE_GROUP = 256


class Block:
    __slots__ = ("text", "path", "link")

    def __init__(self, text: str, path: tuple[str, ...], link: int):
        self.text, self.path, self.link = text, path, link


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """Path tokens of an element: its tag and the words of class, id and role."""
    if "=" not in attrs:
        return (tag,)
    words = [w for m in ATTRIBUTE.finditer(attrs) for w in re.split(r"[^a-z0-9]+", m[2].lower()) if w]
    return (tag, *(f"{tag}.{w}" for w in words), *(f".{w}" for w in words))


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order: text between block-level tags, character
    references decoded, white space as one blank, empty ones left out.
    Scripts, styles, comments and the head never get that far; the head ends
    at its end tag or at the first text or element that cannot lie in it."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked: list[str] = []
    at, links, in_head = 0, 0, False

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and not in_head:
                path = tuple(n for _, names in stack for n in names)
                link = len(" ".join(entities.unescape("".join(linked)).split())) if linked else 0
                out.append(Block(text, (*path, f"own:{stack[-1][0] if stack else ''}"), link))
            held.clear()
        linked.clear()

    def leave_head() -> None:
        nonlocal in_head
        flush()
        in_head = False
        for i, (tag, _) in enumerate(stack):
            if tag == "head":
                del stack[i:]
                break

    def ends_head(piece: str) -> bool:
        return bool(stack) and stack[-1][0] == "head" and not piece.isspace()

    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if in_head and ends_head(piece):
                leave_head()
            held.append(piece)
            if links:
                linked.append(piece)
        at = m.end()
        name, ends = m["name"] or m["name2"], bool(m["end"] or m["end2"])
        if name is None:  # comment, script, declaration
            continue
        name = name.lower()
        # in a title, inline elements are text
        if in_head and not ends and name not in HEAD and (name in BLOCK or not stack or stack[-1][0] != "title"):
            leave_head()
        if name == "a":
            links = max(0, links - 1) if ends else links + 1
        if name == "br":
            held.append(" ")
        if name not in BLOCK:
            continue
        flush()
        links = 0
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            if name == "head":
                in_head = False
            continue
        gone = CLOSES.get(name) or ({"p"} if name in FENCE or name[0] == "h" else None)
        if gone:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in gone:
                    del stack[i:]
                elif stack[i][0] in FENCE:
                    break
        if name == "head":
            in_head = True
        if name not in VOID:
            stack.append((name, _names(name, m["attrs"] or "")))
    if in_head and page[at:] and ends_head(page[at:]):
        leave_head()
    held.append(page[at:])
    flush()
    return out


# -- features ------------------------------------------------------------------
_PATHS = Bounded(50_000)
_WORDS = Bounded(200_000)


def path_rows(path: tuple[str, ...]) -> np.ndarray:
    return np.array([zlib.crc32(p.encode("utf-8", "replace")) % PATH_ROWS for p in path], np.int64)


def word_rows(words: list[str]) -> np.ndarray:
    if fresh := _WORDS.missing(set(words)):
        _WORDS.update((w, zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_ROWS) for w in fresh)
    return np.fromiter((_WORDS[w] for w in words), np.int64, len(words))


class Features:
    """Index arrays of a run of pages, block by block."""

    def __init__(self, pages: list[list[Block]]):
        blocks = [b for p in pages for b in p]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        n = len(blocks)
        _PATHS.missing({b.path for b in blocks})
        rows = []
        for b in blocks:
            if b.path not in _PATHS:
                _PATHS[b.path] = path_rows(b.path)
            rows.append(_PATHS[b.path])
        self.path_len = np.array([len(r) for r in rows], np.int64)
        self.path = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        words = [b.text.split(" ") for b in blocks]
        self.word_len = np.array([len(w) for w in words], np.int64)
        self.word = word_rows([w for ws in words for w in ws])
        x = np.zeros((n, MEASURES), np.float32)
        size = np.array([len(b.text) for b in blocks], np.float32)
        x[:, 0] = np.log1p(self.word_len) / 5
        x[:, 1] = np.array([b.link for b in blocks], np.float32) / np.maximum(size, 1)
        x[:, 2] = [b.text[-1] in ".!?…。" for b in blocks]
        x[:, 3] = [b.text[0].isupper() for b in blocks]
        starts = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        x[:, 4] = (np.arange(n) - starts) / np.maximum(np.repeat(self.lengths, self.lengths), 1)
        x[:, 5] = 1
        self.measures = x


def _mean(table: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(lengths):
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[rows], np.cumsum(lengths) - lengths) / lengths[:, None].astype(np.float32)


# -- the network -----------------------------------------------------------------
def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, lengths: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States of sequences that lie one after another in ``x``.  Sequences run
    side by side, longest first; finished ones leave the batch."""
    gates = x @ w + b
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    out = np.zeros((len(x), HIDDEN), np.float32)
    h = np.zeros((len(order), HIDDEN), np.float32)
    c = np.zeros_like(h)
    for t in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -t, "left"))  # sequences longer than t
        at = begin[:k] + t
        g = gates[at] + h[:k] @ u
        s = sigmoid(g[:, : 3 * HIDDEN])
        c[:k] = s[:, HIDDEN : 2 * HIDDEN] * c[:k] + s[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])
        h[:k] = s[:, 2 * HIDDEN :] * np.tanh(c[:k])
        out[at] = h[:k]
    return out


def reversal(lengths: np.ndarray) -> np.ndarray:
    """Index that turns every sequence around."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(int(lengths.sum())) - starts
    return starts + np.repeat(lengths, lengths) - 1 - place


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([_mean(self.w["path"], f.path, f.path_len), _mean(self.w["word"], f.word, f.word_len), f.measures], axis=1).astype(np.float32)

    def scores(self, f: Features) -> np.ndarray:
        """Probability of each block to be main text."""
        w = self.w
        x = self.inputs(f)
        ahead = lstm(x, f.lengths, w["wf"], w["uf"], w["bf"])
        turn = reversal(f.lengths)
        back = lstm(x[turn], f.lengths, w["wb"], w["ub"], w["bb"])[turn]
        return sigmoid(np.concatenate([ahead, back], axis=1) @ w["v"] + w["d"])[:, 0]

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page, blocks joined by newlines."""
        parsed = [blocks_of(p) for p in pages]
        f = Features(parsed)
        if not len(f.measures):
            return [""] * len(pages)
        main = self.scores(f) >= 0.5
        out, at = [], 0
        for p in parsed:
            out.append("\n".join(b.text for b, m in zip(p, main[at : at + len(p)], strict=True) if m))
            at += len(p)
        return out


_LABELLER: list[Labeller] = []


def labeller() -> Labeller:
    """The trained network, once per worker process."""
    if not _LABELLER:
        data = resources.files("tidemark.llm").joinpath("html_weights.npz").read_bytes()
        _LABELLER.append(Labeller(dict(np.load(io.BytesIO(data)))))
    return _LABELLER[0]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty page has the empty text; a page of any length is read as a
    whole.  Rows are independent, repeated ones too: nothing is shuffled.
    Other columns are not read.  A block whose score is exactly one half is
    main text."""

    def run(batches):
        tool = labeller()
        for batch in batches:
            html = batch.column("html").to_pylist()
            for low, part in groups(html):
                for i in range(0, len(part), PAGE_GROUP):
                    texts = tool.texts(part[i : i + PAGE_GROUP])
                    ids = batch.slice(low + i, len(texts))
                    yield pa.RecordBatch.from_arrays([ids.column("page_id"), ids.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(source, run, "page_id bigint, url string, text string, n_chars bigint")
