"""Main text of HTML pages, with boilerplate found by a suffix array over each host's pages.

A page is cut into blocks at block-level tags; scripts, styles, comments, the head and markup go, character references are decoded and white
space in a block becomes one space. What the page itself declares comes first: blocks inside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments (by element, role, class or id) are never main text (the class or id of the document, of an article and of what
holds the longest article says nothing), and if there is an ``article`` or ``main`` element, only
what is inside it is. Everything else is undecided, and is decided by repetition.

For that the token streams of the pages of a host are concatenated, with a different mark after each page, and their suffixes are sorted to the
depth of ``LONG`` tokens by prefix doubling: each round ranks the suffixes by pairs of earlier ranks and drops those that are alone, so that what
is left at the end are the neighbours in the suffix array that share at least ``LONG`` tokens. Groups of neighbours from different pages are
repeated substrings; the tokens they cover are boilerplate. An undecided block of which half or more is covered goes, a block of mostly unique
runs stays. Pages with equal streams are one page here, so a mirrored page does not delete itself.

Pages are parsed once, in pieces of about ``CHUNK`` bytes as they are stored, with a suffix array for each host of a piece, so no task holds a whole
host and the text is not shuffled: it is written once, in buckets by piece. What repeats only between pieces is found in two rounds. Of each window of
``LONG`` tokens its least ``GRAM``-token hash is taken, the same for equal windows; the distinct ones of a piece, packed as differences by hash range, meet
those of other pieces. Windows around hashes of several pieces are then compared themselves in the same way, with the streams they come from, and
those of several streams go back to the pieces that hold them once. A group is a range of hashes, as many as there are units of ``RANGE`` bytes. So results do not depend on how pages are cut.

Open tags without any end behind them are text, in time linear in the page. Null html is an empty page and a page without text has the empty string. Null URLs form a host of their own. Rows that repeat give a row each.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import buckets, new_path
from .url_reputation import host_and_path

LONG = 8
# Tokens of the parts by which windows are found: a third of all positions at five parts in a window.
GRAM = 4
CHUNK = 1 << 23
# Bytes up to which a token is hashed together with the others.
MIXED = 64
# Bytes of html whose part hashes are compared in one group.
RANGE = 1 << 26
COVERED = 0.5

# Elements of HTML by role.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title"
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav footer aside form dialog menu search button datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# elements whose end tag may be left out: a block that starts inside ends them
LOOSE = frozenset("p li dt dd option td th tr caption".split())
CONTENT = frozenset(["article", "main"])
# elements that a word of their class or id does not make boilerplate
WHOLE = CONTENT | {"html", "body"}
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar comment comments "
    "reply replies disqus respond discussion related recommended share sharing social widget login signup search pagination pager".split()
)

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[/!?a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
# any attribute with its whole name, so that a value is read over and data-id is not id
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# what words name such an element holds articles of readers, not the page's
REMARKS = frozenset("comment comments reply replies disqus respond discussion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    #: declared boilerplate, or declared main text
    chrome: bool
    content: bool


def _declared(name: str, attributes: str, in_content: bool) -> tuple[bool, set[str], bool]:
    """Whether an element is declared boilerplate, the words of its class or id if only they say so, and whether it is declared main text."""
    chrome = name in CHROME or (name == "header" and not in_content)
    content, words = name in CONTENT, set()
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "role" and value.lower() in CHROME_ROLES):
            chrome = True
        elif (key == "role" and value.lower() in CONTENT) or (key == "itemprop" and value == "articleBody"):
            content = True
        elif key in ("class", "id"):
            words |= {w.lower() for w in PIECES.findall(value)}
    said = words & (CHROME_WORDS if in_content else CHROME_WORDS | {"header"})
    if in_content and name in HEADINGS:
        said = set()  # identifiers of headings are made of their text
    if in_content and name == "article" and words & REMARKS:
        chrome = True
    return chrome, said if not (chrome or content or name in WHOLE) else set(), content and not chrome


def blocks_of(page: str | None, known: dict[tuple[str, str, bool], tuple[bool, set[str], bool]] | None = None) -> list[Block]:
    """The blocks of a page with text in them, in order; ``known`` keeps what tags declare, from page to page.

    Words of a class or id do not make boilerplate of what holds the longest article, unless they name comments and the page has other text.
    """
    page, known = page or "", {} if known is None else known
    # behind the last end of a tag nothing but a comment begins, so that no search for an end runs over the rest of the page again and again
    last = page.rfind(">") + 1
    opened = page.find("<!--", last)
    opened = len(page) if opened < 0 else opened
    page = page[:last] + page[last:opened].replace("<", "&lt;") + page[opened:]
    found: list[Block] = []
    # outside of articles: the elements that only words mark and the article that a block lies in
    where: list[tuple[tuple[int, ...], int | None]] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    parts: list[str] = []
    chrome = content = 0  # open elements that are declared so
    worded: list[int] = []  # open elements that words mark, by number
    said_of: list[set[str]] = []
    holders: list[tuple[int, ...]] = []  # of each article

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(text, chrome > 0, content > 0))
            where.append((tuple(worded), len(holders) - 1 if content > 0 and holders else None))
        parts.clear()

    def pop(to: int) -> None:
        nonlocal chrome, content
        while len(stack) > to:
            _, was_chrome, was_worded, was_content = stack.pop()
            chrome -= was_chrome
            content -= was_content
            if was_worded:
                worded.pop()

    at = 0
    for m in TAG.finditer(page):
        start, end = m.span()
        if start > at:
            parts.append(page[at:start])
        at = end
        _, slash, name, attributes = m.groups()
        if name is None:
            continue
        name = name.lower()
        is_block = name in BLOCKS
        if slash:  # an end tag
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != name:
                depth -= 1
            depth = depth if depth >= 0 else None
            if is_block or depth is not None and any(stack[depth][1:]):
                close()
            if depth is not None:
                pop(depth)
            continue
        if name == "br":
            parts.append(" ")
        if is_block:
            close()
            if stack and stack[-1][0] in LOOSE and (stack[-1][0] == "p" or stack[-1][0] == name):
                pop(len(stack) - 1)
        if name in VOID:
            continue
        tag = (name, attributes, content > 0)
        if (declared := known.get(tag)) is None:
            declared = _declared(*tag)
            if len(attributes) <= 100:  # templates repeat their tags
                known[tag] = declared
        said, words, main = declared
        if is_block or said or words or main:
            if (said or words or main) and not is_block:
                close()
            apart = bool(words) and content == 0
            said = said or bool(words) and not apart
            stack.append((name, said, apart, main))
            if apart:
                worded.append(len(said_of))
                said_of.append(words)
            if main and content == 0:
                holders.append(tuple(worded))
            chrome += said
            content += main
    if at < len(page):
        parts.append(page[at:])
    close()
    sizes: dict[int, int] = {}
    for b, (_, article) in zip(found, where):
        if article is not None and not b.chrome:
            sizes[article] = sizes.get(article, 0) + len(b.text)
    lifted: set[int] = set()
    if sizes:
        around = holders[max(sizes, key=sizes.get)]
        other = any(not b.chrome and not marks for b, (marks, _) in zip(found, where))
        if not (other and any(said_of[k] & REMARKS for k in around)):
            lifted.update(around)
    for b, (marks, _) in zip(found, where):
        b.chrome = b.chrome or not lifted.issuperset(marks)
    return found


def is_open(blocks: list[Block]) -> bool:
    """Whether a page has blocks that only repetition can decide."""
    return not any(b.content and not b.chrome for b in blocks) and any(not b.chrome for b in blocks)


def stream_of(blocks: list[Block]) -> list[str]:
    return [word for b in blocks for word in b.text.split()]


def stream_hash(stream: str) -> int:
    """Of a stream as its tokens with single spaces between."""
    return int.from_bytes(hashlib.blake2b(stream.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def repeated(streams: list[list[str]], long: int = LONG) -> list[np.ndarray]:
    """For each stream, which of its tokens are covered by substrings of at least ``long`` tokens that occur in another stream as well."""
    ids: dict[str, int] = {}
    return repeated_numbers([np.array([ids.setdefault(t, len(ids)) for t in tokens], dtype=np.int64) for tokens in streams], long)


def repeated_numbers(streams: list[np.ndarray], long: int = LONG) -> list[np.ndarray]:
    """``repeated`` of streams of token numbers, which count from 0."""
    if not streams:
        return []
    mark = np.array([-1])  # ends each page; no suffix goes on past it
    rank = np.concatenate([part for stream in streams for part in (stream, mark)])
    sizes = np.array([stream.size + 1 for stream in streams])
    of = np.repeat(np.arange(len(streams)), sizes)
    active = np.flatnonzero(rank >= 0)
    depth = 1
    while depth < long and active.size:
        step = min(depth, long - depth)
        ahead = active + step
        active, ahead = active[ahead < rank.size], ahead[ahead < rank.size]
        active, ahead = active[rank[ahead] >= 0], ahead[rank[ahead] >= 0]
        pairs = rank[active] * (int(rank.max()) + 1) + rank[ahead]
        order = np.argsort(pairs)
        fresh = np.diff(pairs[order], prepend=-1) != 0
        times = np.diff(np.r_[np.flatnonzero(fresh), pairs.size])
        new = np.cumsum(fresh) - 1
        several = times[new] > 1  # those that are alone have no equal neighbour at any greater depth
        rank = np.full(rank.size, -1, dtype=np.int64)
        rank[active[order[several]]] = new[several]
        active = np.flatnonzero(rank >= 0)
        depth += step
    change = np.zeros(rank.size + 1, dtype=np.int64)
    if active.size:
        # the suffix array of what is left: equal ranks are neighbours with a common prefix of ``long`` tokens
        array = active[np.lexsort((active, rank[active]))]
        starts = np.flatnonzero(np.r_[True, np.diff(rank[array]) != 0])
        ends = np.r_[starts[1:], array.size]
        pages = of[array]  # grows within a group
        shared = np.repeat(pages[starts] != pages[ends - 1], ends - starts)
        change[array[shared]] += 1
        change[array[shared] + long] -= 1
    covered = np.cumsum(change[:-1]) > 0
    return [covered[end - size : end - 1] for size, end in zip(sizes.tolist(), np.cumsum(sizes).tolist())]


def token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """64-bit numbers with each bit spread over all."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        numbers = (numbers ^ (numbers >> np.uint64(33))) * np.uint64(factor)
    return numbers ^ (numbers >> np.uint64(33))


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """A 64-bit hash of each token: its length and bytes mixed eight by eight, for a token of more than ``MIXED`` bytes ``token_hash``."""
    kind = np.int64 if pa.types.is_large_string(tokens.type) else np.int32
    _, offsets, data = tokens.buffers()
    bounds = np.frombuffer(offsets, kind)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64) if len(tokens) else np.zeros(1, np.int64)
    starts, sizes = bounds[:-1], np.diff(bounds)
    padded = np.concatenate([np.frombuffer(data or b"", np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray((padded.size - 7,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    out = sizes.astype(np.uint64)
    at = np.flatnonzero(sizes <= MIXED)
    for k in range(0, MIXED, 8):
        at = at[sizes[at] > k]
        out[at] = _mixed(out[at] ^ (eights[starts[at] + k] & masks[np.minimum(sizes[at] - k, 8)]) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(sizes > MIXED)
    out[long] = np.fromiter(map(token_hash, tokens.take(pa.array(long)).to_pylist()), np.uint64, long.size)
    return out


def windows_of(coded: np.ndarray, long: int = LONG) -> np.ndarray:
    """A 64-bit hash of each run of ``long`` tokens, given the hashes of the tokens."""
    n = max(coded.size - long + 1, 0)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(long):
        total = total * np.uint64(0x9E3779B97F4A7C15) + coded[k : k + n]
    return total


def least_parts(coded: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all parts of a run of tokens and, for each window of ``long`` tokens, where its first least part starts."""
    size = min(GRAM, long)
    parts = windows_of(coded, size)
    n = max(coded.size - long + 1, 0)
    at, least = np.arange(n), parts[:n].copy()
    for k in range(1, long - size + 1):
        less = np.flatnonzero(parts[k : k + n] < least)
        least[less] = parts[k + less]
        at[less] = k + less
    return parts, at


def pack(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed differences."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def cut_by_range(numbers: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each range of ascending numbers starts, and what stands above the lowest ``cut`` bits in it."""
    ranges = numbers >> np.uint64(cut) if cut < 64 else np.zeros(numbers.size, dtype=np.uint64)
    starts = np.flatnonzero(np.r_[numbers.size > 0, np.diff(ranges) != 0])
    return starts, ranges[starts].astype(np.int64)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def main_text(blocks: list[Block], covered: np.ndarray) -> tuple[str, int]:
    """Text of the blocks that stay, joined by line feeds, and how many undecided blocks were removed as repeated."""
    if not is_open(blocks):
        return "\n".join(b.text for b in blocks if b.content and not b.chrome), 0
    kept, at, removed = [], 0, 0
    before = [0, *np.cumsum(covered).tolist()]
    for b in blocks:
        n = b.text.count(" ") + 1
        if not b.chrome:
            if (before[at + n] - before[at]) / n < COVERED:
                kept.append(b.text)
            else:
                removed += 1
        at += n
    return "\n".join(kept), removed


@dataclass
class Streams:
    """The token streams of a piece, one behind the other: of each page which one, of each distinct one of a host the first page that has it."""

    of: list[int]
    first: list[int]
    hosts: list[str | None]
    hashes: list[int]
    #: where the tokens of each stream start and end
    starts: np.ndarray
    ends: np.ndarray
    tokens: pa.Array

    @classmethod
    def read(cls, hosts: list[str | None], texts: pa.ListArray, hashes: list[int]) -> Streams:
        """From the texts of the blocks of each page, which are tokens with single spaces between, and the hashes of their streams."""
        known: dict[tuple[str | None, int], int] = {}
        of, first = [], []
        for k, named in enumerate(zip(hosts, hashes)):
            if named not in known:
                known[named] = len(known)
                first.append(k)
            of.append(known[named])
        chosen = texts.take(pa.array(first, pa.int64()))
        n_blocks = np.r_[0, np.cumsum(chosen.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        split = pc.split_pattern(chosen.flatten(), " ")
        n_tokens = np.r_[0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        bounds = n_tokens[n_blocks]
        return cls(of, first, [hosts[k] for k in first], [hashes[k] for k in first], bounds[:-1], bounds[1:], split.flatten())

    def covered(self, long: int) -> np.ndarray:
        """Which tokens are covered by what repeats in other streams of the host."""
        by_host: dict[str | None, list[int]] = {}
        for k, host in enumerate(self.hosts):
            by_host.setdefault(host, []).append(k)
        out = np.zeros(len(self.tokens), dtype=bool)
        numbers = self.tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for chosen in by_host.values():
            bounds = [(self.starts[k], self.ends[k]) for k in chosen]
            for (start, end), mask in zip(bounds, repeated_numbers([numbers[start:end] for start, end in bounds], long)):
                out[start:end] = mask
        return out

    def per_token(self, values: np.ndarray) -> np.ndarray:
        """The value of its stream for each token."""
        return np.repeat(values, self.ends - self.starts)

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the host and the own hash of each token."""
        # a blank is no token, and a missing host is not the empty one
        known = {host: token_hash("\n" if host is None else " " + host) for host in set(self.hosts)}
        return self.per_token(np.fromiter((known[host] for host in self.hosts), np.uint64, len(self.hosts))), token_hashes(self.tokens)

    def inside(self, long: int) -> np.ndarray:
        """Which windows of ``long`` tokens, by their start, lie in one stream."""
        n = max(len(self.tokens) - long + 1, 0)
        return np.arange(n) + long <= self.per_token(self.ends)[:n]


def _short(parts: np.ndarray, host: np.uint64, bits: int) -> np.ndarray:
    """Part hashes of a host in ``bits`` bits."""
    return ((parts ^ host) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _chosen(at: np.ndarray, n: int) -> np.ndarray:
    """The distinct ones of some numbers below ``n``, in order."""
    mask = np.zeros(n, dtype=bool)
    mask[at] = True
    return np.flatnonzero(mask)


def _sorted_in(numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the numbers are among the ascending ``known``."""
    if not known.size:
        return np.zeros(numbers.size, dtype=bool)
    return known[np.minimum(np.searchsorted(known, numbers), known.size - 1)] == numbers


def _runs(mask: np.ndarray) -> list[int]:
    """Starts and ends of the runs of a mask, in turn."""
    return np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()


def _parsed(pages: DataFrame, long: int, bits: int, cut: int) -> DataFrame:
    """Pieces of pages: a row for each page with its blocks and what its piece covers of them, and one for each range of part hashes of the piece."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = pages.schema["page_id"].dataType
    kinds = {
        "piece": pa.int64(), "host": pa.string(), "page_id": to_arrow_type(id_type), "url": pa.string(), "texts": pa.list_(pa.string()),
        "marks": pa.list_(pa.int8()), "stream": pa.int64(), "covered": pa.list_(pa.int32()), "range": pa.int64(), "parts": pa.binary(),
    }

    def batch(n: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in kinds.items()], names=list(kinds))

    def cut_piece(rows: list[dict], piece: int) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str, bool], tuple[bool, set[str], bool]] = {}
        parsed = [blocks_of(r["html"], known) for r in rows]
        texts = pa.array([[b.text for b in p] for p in parsed], pa.list_(pa.string()))
        hashes = [stream_hash(" ".join([b.text for b in p])) for p in parsed]
        streams = Streams.read([r["host"] for r in rows], texts, hashes)
        covered = streams.covered(long)
        runs = [_runs(covered[start:end]) for start, end in zip(streams.starts, streams.ends)]
        yield batch(
            len(rows), piece=[piece] * len(rows), host=[r["host"] for r in rows], page_id=[r["page_id"] for r in rows], url=[r["url"] for r in rows],
            texts=texts, marks=[[b.chrome + 2 * b.content for b in p] for p in parsed],
            stream=hashes, covered=[runs[k] for k in streams.of],
        )
        host, coded = streams.coded()
        parts, least = least_parts(coded, long)
        used = _chosen(least[streams.inside(long)], parts.size)
        every = np.sort(_short(parts[used], host[used], bits))
        every = every[np.flatnonzero(np.r_[every.size > 0, np.diff(every) != 0])]
        if every.size:
            starts, ranges = cut_by_range(every, cut)
            packed = [pack(part) for part in np.split(every, starts[1:])]
            yield batch(starts.size, piece=[piece] * starts.size, range=ranges.tolist(), parts=packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for rows in batches:
            for r in rows.to_pylist():
                held.append(r)
                size += len(r["html"] or "")
                if size >= CHUNK:
                    yield from cut_piece(held, piece)
                    held, size, piece = [], 0, piece + 1
        if held:
            yield from cut_piece(held, piece)

    return pages.mapInArrow(
        run,
        f"piece long, host string, page_id {id_type.simpleString()}, url string, texts array<string>, marks array<tinyint>, stream long, covered array<int>, "
        "`range` long, parts binary",
    )


def _several(parsed: DataFrame) -> DataFrame:
    """(piece, parts) of the part hashes of a piece that other pieces have too, a row for each range."""

    def compare(group: pa.Table) -> pa.Table:
        pieces = np.array(group["piece"].to_pylist(), dtype=np.int64)
        parts = [unpack(p) for p in group["parts"].to_pylist()]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        shared = values[counts > 1]
        found = [p[_sorted_in(p, shared)] for p in parts]
        kept = [k for k, p in enumerate(found) if p.size]
        return pa.table({"piece": pa.array(pieces[kept]), "parts": pa.array([pack(found[k]) for k in kept], pa.binary())})

    return parsed.filter("parts IS NOT NULL").select("piece", "range", "parts").groupBy("range").applyInArrow(compare, "piece long, parts binary")


def _windows(texts: DataFrame, several: DataFrame, long: int, bits: int, cut: int) -> DataFrame:
    """Windows of a piece around part hashes of several pieces, a row for each range: piece, range, windows (ascending, packed), streams (their
    distinct streams, packed) and which of them each window comes from; stream 0 stands for several streams of the piece."""
    names = ["piece", "range", "windows", "streams", "which"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))))

    def find(pages: pa.Table, parts: pa.Table) -> pa.Table:
        if not pages.num_rows or not parts.num_rows:
            return schema.empty_table()
        known = np.sort(np.concatenate([unpack(p) for p in parts["parts"].to_pylist()]))
        streams = Streams.read(pages["host"].to_pylist(), pages["texts"].combine_chunks(), pages["stream"].to_pylist())
        host, coded = streams.coded()
        all_parts, least = least_parts(coded, long)
        inside = streams.inside(long)
        used = _chosen(least[inside], all_parts.size)
        wanted = np.zeros(all_parts.size, dtype=bool)
        wanted[used] = _sorted_in(_short(all_parts[used], host[used], bits), known)
        at = np.flatnonzero(inside & wanted[least])
        window = windows_of(coded, long)[at] ^ host[at]
        source = streams.per_token(np.array(streams.hashes, dtype=np.int64).view(np.uint64))[at]
        order = np.lexsort((source, window))
        window, source = window[order], source[order]
        firsts = np.flatnonzero(np.r_[window.size > 0, np.diff(window) != 0])
        lasts = np.r_[firsts[1:], window.size][: firsts.size] - 1
        window, source = window[firsts], np.where(source[firsts] == source[lasts], source[firsts], np.uint64(0))
        starts, ranges = cut_by_range(window, cut)
        piece, rows = pages["piece"][0].as_py(), []
        for k, of, found in zip(ranges.tolist(), np.split(source, starts[1:]), np.split(window, starts[1:])):
            distinct, which = np.unique(of, return_inverse=True)
            planes = np.ascontiguousarray(which.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            rows.append((piece, k, pack(found), pack(distinct), zstandard.compress(planes.tobytes())))
        return pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=schema) if starts.size else schema.empty_table()

    schemas = "piece long, `range` long, windows binary, streams binary, which binary"
    return texts.groupBy("piece").cogroup(several.groupBy("piece")).applyInArrow(find, schemas)


def _asked(windows: DataFrame) -> DataFrame:
    """(piece, windows) of the windows that a piece has in one stream only and another piece in another, a row for each range."""

    def compare(group: pa.Table) -> pa.Table:
        found = [unpack(w) for w in group["windows"].to_pylist()]
        sources = []
        for streams, which in zip(group["streams"].to_pylist(), group["which"].to_pylist()):
            planes = np.frombuffer(zstandard.decompress(which), np.uint8).reshape(4, -1)
            sources.append(unpack(streams)[np.ascontiguousarray(planes.T).view("<u4").ravel()])
        window, source = np.concatenate(found), np.concatenate(sources)
        order = np.lexsort((source, window))
        window, source = window[order], source[order]
        firsts = np.flatnonzero(np.r_[True, np.diff(window) != 0])
        lasts = np.r_[firsts[1:], window.size] - 1
        # the least source is 0 where a piece has several
        shared = window[firsts[(source[firsts] != source[lasts]) | (source[firsts] == 0)]]
        asked = [w[_sorted_in(w, shared) & (of != 0)] for w, of in zip(found, sources)]
        kept = [k for k, w in enumerate(asked) if w.size]
        pieces = np.array(group["piece"].to_pylist(), dtype=np.int64)
        return pa.table({"piece": pa.array(pieces[kept]), "windows": pa.array([pack(asked[k]) for k in kept], pa.binary())})

    return windows.groupBy("range").applyInArrow(compare, "piece long, windows binary")


def extract(pages: DataFrame, long: int = LONG) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (tokens covered by repeated substrings) and n_removed (undecided blocks removed as
    repeated) of every row of ``pages``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, id_type = pages.sparkSession, pages.schema["page_id"].dataType
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    bits = min(64, total.bit_length() + 10)
    name = f"pieces_{uuid.uuid4().hex}"
    n = max(buckets(spark), total // RANGE)
    writer = _parsed(rows, long, bits, bits - (total // RANGE).bit_length()).write.format("parquet").option("compression", "zstd")
    writer.bucketBy(n, "piece").option("path", new_path(spark, "pieces")).saveAsTable(name)
    parsed = spark.table(name)
    texts = parsed.filter("parts IS NULL")
    several = _several(parsed)
    asked = _asked(_windows(texts.select("piece", "host", "texts", "stream"), several, long, bits, 64 - (total // RANGE).bit_length()))

    names = ("page_id", "url", "text", "n_chars", "n_repeated", "n_removed")
    kinds = (to_arrow_type(id_type), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())

    def decide(pages: pa.Table, windows: pa.Table) -> pa.Table:
        rows = pages.to_pylist()
        blocks = [[Block(t, bool(m & 1), bool(m & 2)) for t, m in zip(r["texts"], r["marks"])] for r in rows]
        streams = Streams.read([r["host"] for r in rows], pages["texts"].combine_chunks(), [r["stream"] for r in rows])
        change = np.zeros(len(streams.tokens) + 1, dtype=np.int64)
        for k, start in zip(streams.first, streams.starts):
            runs = start + np.array(rows[k]["covered"], dtype=np.int64)
            np.add.at(change, runs[::2], 1)
            np.add.at(change, runs[1::2], -1)
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(w) for w in windows["windows"].to_pylist())]))
        if known.size:
            host, coded = streams.coded()
            window = windows_of(coded, long)
            at = np.flatnonzero(streams.inside(long) & _sorted_in(window ^ host[: window.size], known))
            change[at] += 1
            change[at + long] -= 1
        covered = np.cumsum(change[:-1]) > 0
        masks = [covered[start:end] for start, end in zip(streams.starts, streams.ends)]
        out = []
        for r, b, k in zip(rows, blocks, streams.of):
            text, removed = main_text(b, masks[k])
            out.append((r["page_id"], r["url"], text, len(text), int(masks[k].sum()), removed))
        columns = list(zip(*out)) or [[]] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))

    pieces = texts.select("piece", "host", "page_id", "url", "texts", "marks", "stream", "covered").groupBy("piece").cogroup(asked.groupBy("piece"))
    return pieces.applyInArrow(decide, f"page_id {id_type.simpleString()}, url string, text string, n_chars long, n_repeated long, n_removed int")
