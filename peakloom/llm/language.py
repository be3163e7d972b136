"""Language identification by cross-parsing entropy.

A text is parsed greedily into the longest pieces that occur in the labelled text of a language.
The fewer pieces it takes, the closer the text is to that language: pieces x log2(training length)
/ text length estimates the cross entropy in bits per character. Longest matches come from the
suffix automaton of the labelled text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import annotate, table

# Distinct labelled texts sampled per language, the longest window taken from each, and characters
# used in all; every sampled text gives an equal share. These bound the model, not the texts it is
# applied to.
ROWS_PER_LANGUAGE = 64
CHARS_PER_ROW = 2_000
CHARS_PER_LANGUAGE = 24_000
# Text parsed at once inside a task; a longer text is a piece of its own.
PIECE_BYTES = 1_000_000
# Code points; every letter of a language's training text has a code there.
ALPHABET = 0x110000
# Codes of a language whose transitions are in a table; those of its rarer letters are searched.
DENSE = 64
# No piece crosses a multiple of this position, so that blocks of all texts advance together.
BLOCK = 1_024
UNKNOWN = "und"


def held_out(doc_id):
    """Rows that are kept away from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE) -> dict[str, str]:
    """Normalised labelled text per language, from a sample bounded by ``rows`` and ``chars``.

    Uses text and lang of the rows that are not held out. Which texts are sampled depends on a hash of
    the text, copies count once; languages with few texts give all of them. From each comes a window at
    a hashed position, so that beginnings count no more than other parts. Without labelled rows the
    result is empty.
    """
    mark = F.xxhash64("text", F.lit("language sample"))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("h", mark)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return {}
    # texts whose hash falls below a share that holds twice the wanted number; then the first of them
    ticket = F.pmod("h", F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * rows / n + 8.0 / n)))])
    start = F.pmod(F.xxhash64("h", F.lit("start")), F.greatest(F.length("text") - F.lit(CHARS_PER_ROW), F.lit(0)) + 1)
    picked = known.where(ticket < share[F.col("lang")]).select("lang", "h", ticket.alias("t"), F.substring("text", start.cast("int") + 1, F.lit(CHARS_PER_ROW)).alias("text"))
    texts: dict[str, list] = {}
    for r in sorted(picked.groupBy("lang", "h").agg(F.min("t").alias("t"), F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["t"], r["h"])):
        have = texts.setdefault(r["lang"], [])
        if len(have) < rows and any(c.isalpha() for c in r["text"]):
            have.append(fold(r["text"]))
    return {lang: " ".join(_shares(have, chars)) for lang, have in texts.items() if have}


def _shares(texts: list[str], chars: int) -> list[str]:
    """The texts, each cut to an equal share of ``chars``; what short ones leave goes to the others."""
    out, left = {}, chars
    for at, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        out[i] = texts[i][: max(0, left // (len(texts) - at) - 1)]
        left -= len(out[i]) + 1
    return [out[i] for i in range(len(texts)) if out[i]]


def fold(text: str) -> str:
    """Lower case, every run of other characters than letters as one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of every state of the suffix automaton of ``codes``; state 0 is the start."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def build(training: dict[str, str]) -> tuple:
    """(languages, number of every code point, automaton of each language, bits per piece), all arrays.

    Number 0 is a letter in no training text, 1 the blank and everything that is no letter. An automaton
    is (own code of every number, table of the transitions of codes under DENSE, sorted keys and targets
    of the others). Codes go by frequency in the language; code 0 has no transition, 1 is the blank.
    """
    languages = sorted(training)
    letters = sorted({c for text in training.values() for c in text} - {" "})
    numbers = np.ones(ALPHABET, dtype=np.int32)
    numbers[np.fromiter((chr(i).isalpha() for i in range(ALPHABET)), bool, ALPHABET)] = 0
    for i, c in enumerate(letters):
        numbers[ord(c)] = i + 2
    machines, bits = [], []
    for lang in languages:
        text = training[lang]
        seen = Counter(text)
        seen.pop(" ", None)
        code = {" ": 1} | {c: i + 2 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}
        own = np.zeros(len(letters) + 2, dtype=np.int32)
        for c, i in code.items():
            own[numbers[ord(c)]] = i
        states = automaton([code[c] for c in text])
        table_ = np.zeros((len(states), DENSE), dtype=np.min_scalar_type(len(states)))
        rare = []
        for state, moves in enumerate(states):
            for c, to in moves.items():
                if c < DENSE:
                    table_[state, c] = to
                else:
                    rare.append((state * ALPHABET + c, to))
        rare = np.array(sorted(rare), dtype=np.int64).reshape(-1, 2)
        # target 0 means "none": no transition leads back to the start
        machines.append((own, table_.reshape(-1), rare[:, 0].copy(), rare[:, 1].astype(table_.dtype)))
        bits.append(math.log2(max(2, len(text))))
    return languages, numbers, machines, np.array(bits)


def _targets(machine: tuple, state: np.ndarray, code: np.ndarray) -> np.ndarray:
    _, flat, keys, targets = machine
    if not len(keys):
        return flat[state * np.int64(DENSE) + code]
    common = code < DENSE
    to = np.where(common, flat[state * np.int64(DENSE) + np.where(common, code, 0)], 0)
    rare = np.flatnonzero(~common)
    if len(rare):
        wanted = state[rare] * np.int64(ALPHABET) + code[rare]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        to[rare] = np.where(keys[at] == wanted, targets[at], 0)
    return to


def count_pieces(blocks: list[np.ndarray], machines: list[tuple]) -> np.ndarray:
    """Pieces [block, language] of greedy longest-match parsing; all blocks advance one character
    at a time, the longest first so that finished ones drop off the end."""
    out = np.zeros((len(blocks), len(machines)), dtype=np.int64)
    if not blocks:
        return out
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    longest = int(sizes[0])
    grid = np.zeros((longest, len(blocks)), dtype=np.int32)
    for column, i in enumerate(order):
        grid[: sizes[column], column] = blocks[i]
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")
    for k, machine in enumerate(machines):
        state = np.zeros(len(blocks), dtype=np.int32)  # 0: no piece is open
        count = np.zeros(len(blocks), dtype=np.int64)
        nowhere = np.zeros(len(blocks), dtype=np.int32)
        for step in range(longest):
            n = alive[step]
            c = machine[0][grid[step, :n]]
            s = state[:n]
            to = np.where(s > 0, _targets(machine, s, c), 0)
            fresh = to == 0
            count[:n] += fresh
            state[:n] = np.where(fresh, _targets(machine, nowhere[:n], c), to)
        out[order, k] = count
    return out


def predict(texts: list[str | None], model: tuple) -> tuple[list[str], list[float]]:
    """Language and score of every text; score is 1 - best / (best + second), 0.5 for a tie."""
    languages, numbers, machines, bits = model
    blocks: list[np.ndarray] = []
    owner: list[int] = []
    lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    for i, text in enumerate(texts):
        if not lettered[i] or not languages:
            continue
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = numbers[points]
        blank = c == 1
        c = c[~(blank & np.concatenate([[True], blank[:-1]]))]
        for at in range(0, len(c), BLOCK):
            blocks.append(c[at : at + BLOCK])
            owner.append(i)
    counts = count_pieces(blocks, machines)
    per_text = np.zeros((len(texts), len(machines)))
    np.add.at(per_text, np.array(owner, dtype=np.int64), counts)
    cost = per_text * bits
    names, scores = [], []
    for i in range(len(texts)):
        if not lettered[i] or not languages:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = int(np.argmin(cost[i]))
        names.append(languages[best])
        rest = np.delete(cost[i], best)
        second = float(rest.min()) if len(rest) else math.inf
        scores.append(1.0 if math.isinf(second) else second / (cost[i][best] + second))
    return names, scores


def identify(docs: DataFrame, training: dict[str, str]) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score.

    A null text, an empty one and one without a letter give ``und`` and score 0, as does every text
    when nothing was learned. Equal costs go to the first language in alphabetical order. Rows are
    judged one by one by their text alone; columns named lang_pred or score are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(build(training))  # grows with languages x CHARS_PER_LANGUAGE alone

    def run(texts):
        names, scores = predict(texts, shipped.value)
        return {"lang_pred": names, "score": scores}

    return annotate(docs, [("lang_pred", "string"), ("score", "double")], run, most=PIECE_BYTES)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told; the columns stay as they are."""
    columns = docs.columns
    renamed = docs.withColumnsRenamed({c: f"__in_{c}" for c in ("lang_pred", "score") if c in columns})
    kept = identify(renamed, learn(docs)).where(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"__in_{c}": c for c in ("lang_pred", "score")}).select(*[F.col(f"`{c}`") for c in columns])
