"""Substring dedup by repeated-phrase automata.

Recurring passages are confirmed first: of the candidate snippets that meet in a task (see recurring), windows of words
that stand under two document ids are found by comparing them as strings, and joined into passages, each window in one passage.
For each passage the words that all its windows share become a phrase of an Aho-Corasick automaton. The automaton is
one shard of the whole: a task's. Every snippet is then streamed through it; where a phrase occurs, the passage around it
is compared directly, which locates every window's occurrence and the least id that has it.

A word is removed if a window (50 words by default) that covers it also starts in a document of smaller id. Null texts have no
words; shorter texts have no windows; a null id counts as the largest; rows of one id don't remove each other's words.
Empty table: no rows.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import as_bytes, slices, tidied
from docsift.llm.recurring import Kind, as_runs, batches_by_size, keyed, merged, recurring_spans, with_spans

WIDTH, GRAM = 50, 8
#: Most bytes of snippets that share one automaton, as far as one anchor's snippets allow it.
SHARD = 2 << 20


def word_places(text: str) -> list[int]:
    """Where words start, and one more: behind the blank that would follow the last."""
    out, at = [0], text.find(" ")
    while at >= 0:
        out.append(at + 1)
        at = text.find(" ", at + 1)
    out.append(len(text) + 1)
    return out


def confirm(rows: list[tuple], width: int) -> list[tuple[str, list[str], int]]:
    """Passages: (the words that all of their windows share, the windows in order, the least id)."""
    ids: dict[str, tuple[int, int]] = {}
    placed = []
    for _, _, text, least, most, _ in rows:
        at = word_places(text)
        windows = [text[at[j] : at[j + width] - 1] for j in range(len(at) - width)]
        placed.append((text, at, windows))
        for w in windows:
            known = ids.get(w)
            ids[w] = (least, most) if known is None else (min(known[0], least), max(known[1], most))
    out, taken = [], set()
    for text, at, windows in placed:
        run: list[str] = []
        for j, w in enumerate([*windows, ""]):
            least, most = ids.get(w, (0, 0))
            new = least < most and w not in taken
            if run and (not new or least != ids[run[0]][0]):
                first = j - len(run)
                out.append((text[at[j - 1] : at[first + width] - 1], run, ids[run[0]][0]))
                run = []
            if new:
                taken.add(w)
                run.append(w)
    return out


def locate(rows: list[tuple], passages: list[tuple[str, list[str], int]], width: int) -> list[tuple[int, int, list, int]]:
    """By one automaton of the passages' phrases: for each row its runs of located windows."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    phrases: dict[str, list[tuple[list[int], list[str], int]]] = {}
    for phrase, windows, least in passages:
        # where each window begins, seen from the phrase's start
        last = len(windows) - 1
        lead, starts = 0, [0] * len(windows)
        for j in range(last - 1, -1, -1):  # the phrase begins where the last window does
            lead -= windows[j].index(" ") + 1
            starts[j] = lead
        phrases.setdefault(f" {phrase} ", []).append((starts, windows, least))
    for phrase, own in phrases.items():
        automaton.add_word(phrase, (len(phrase), own))
    if not phrases:
        return []
    automaton.make_automaton()
    out = []
    for anchor, same, text, _, _, times in rows:
        framed, found = f" {text} ", {}
        for end, (size, own) in automaton.iter(framed):
            at = end - size + 2  # the phrase's first word
            for starts, windows, least in own:
                for start, w in zip(starts, windows, strict=True):
                    p = at + start
                    if p > 0 and framed.startswith(w, p) and framed[p - 1] == " " == framed[p + len(w)]:
                        found[p - 1] = least
        if found:
            number = {p: j for j, p in enumerate(word_places(text))}
            runs: list[list[int]] = []
            for j, least in sorted((number[p], least) for p, least in found.items()):
                if runs and runs[-1][1] == j - 1 and runs[-1][2] == least:
                    runs[-1][1] = j
                else:
                    runs.append([j, j, least])
            out.append((anchor, same, [tuple(r) for r in runs], times))
    return out


def resolver(width: int, shard: int = SHARD):
    @tidied
    def resolve(batches):
        # snippets of one anchor must share an automaton, so a task is one shard; its size is bounded by how rows are dealt
        rows = [(a, s, t.decode("utf-8", "surrogateescape"), x, y, n) for part in batches_by_size(batches, shard) for a, s, t, x, y, n in part]
        by_anchor: dict[int, list[tuple]] = {}
        for r in rows:
            by_anchor.setdefault(r[0], []).append(r)
        part, size = [], 0
        for own in [*by_anchor.values(), None]:
            if part and (own is None or size > shard):
                yield as_runs(locate(part, confirm(part, width), width))
                part, size = [], 0
            if own:
                part += own
                size += sum(len(r[2]) for r in own)

    return resolve


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept are the words that stay, joined by blanks."""
    spans = recurring_spans(keyed(docs, id_col, text_col), Kind("words", width, gram), True, resolver(width))
    rows = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), spans, "doc_id", "text", "gone")

    @tidied
    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sizes, removed, kept = [], [], []
                for text, own in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = text.split() if text else []
                    own = merged((s["start"], s["end"]) for s in own or ())
                    keep, at = [], 0
                    for a, b in own:
                        keep += words[at:a]
                        at = b
                    keep += words[at:]
                    sizes.append(len(words))
                    removed.append(len(words) - len(keep))
                    kept.append(b" ".join(keep))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
