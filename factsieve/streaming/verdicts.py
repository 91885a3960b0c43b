"""One verdict per delta of a live text stream, with keyed state."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.functions import patterns
from factsieve.functions.verdicts import (
    BLOCK,
    FLAG,
    NO_TEXT_RULE,
    PASS,
    REASON_NO_TEXT,
    REASON_OK,
    REASON_PII,
)
from factsieve.streaming.state import Columns, keyed_state, plain

_STATE = (
    "tail string, has_text boolean, last_seq bigint, "
    + ", ".join(f"{t} bigint" for t in patterns.PII_PATTERNS)
)


def _domain(piece: str) -> str:
    """The longest domain at the beginning of a piece, or nothing.

    The module would go back over a long run of domain characters more than once, so the
    run and its last ending are found one after the other.
    """
    import regex as re

    run = re.match(patterns.EMAIL_DOMAIN_RUN, piece).end()
    ends = [m.end() for m in re.finditer(patterns.EMAIL_DOMAIN_END, piece[: run + 1]) if m.start()]
    return piece[: ends[-1]] if ends else ""


class _Scanner:
    """Counts matches of a growing text; see ``operators.deltas`` for why cuts are safe."""

    def __init__(self, tail: str, settled: Sequence[int]):
        self.tail = tail
        self.settled = list(settled)

    @staticmethod
    def _email_ends(text: str) -> list[int]:
        """Where addresses end, looking at each ``@`` once; see ``functions.emails``."""
        import regex as re

        pieces = text.split("@")
        ends, taken, at = [], "", len(pieces[0])  # domain of the sign before, if it has an address
        for i in range(1, len(pieces)):
            before = pieces[i - 1]
            domain = _domain(pieces[i])
            run = len(re.match(f"{patterns.EMAIL_RUN}*+", before[::-1]).group())
            whole = run == len(before)
            if not domain:
                hit = False
            elif taken and whole:
                hit = len(taken) < len(before)
            else:
                ahead = ("@" if i > 1 else "") if whole else before[-run - 1]
                own = ahead + before[len(before) - run :]
                hit = re.match(patterns.EMAIL_LOCAL_END.replace(r"\z", r"\Z"), own) is not None
            if hit:
                ends.append(at + 1 + len(domain))
            taken = domain if hit else ""
            at += 1 + len(pieces[i])
        return ends

    @classmethod
    def _emails(cls, text: str) -> int:
        return len(cls._email_ends(text))

    @classmethod
    def _ends(cls, text: str) -> list[list[int]]:
        """Where the matches of each type end."""
        # The third-party module, on the workers: its word boundaries agree with the columns'
        # on combining marks, those of the standard library do not.
        import regex as re

        has_digit = re.search(patterns.DIGIT, text) is not None
        return [
            (cls._email_ends(text) if "@" in text else [])
            if t == "email"
            else ([m.end() for m in re.finditer(p, text)] if has_digit else [])
            for t, p in patterns.PII_PATTERNS.items()
        ]

    def add(self, deltas: Sequence[str]) -> list[list[int]]:
        """Match counts per type of all text so far, after each delta.

        The text up to the last cut is searched once, and each delta gets the matches that
        end before its own last cut. Behind that only the open stretch is looked at, as
        it stands when the delta ends, and only if it has a digit or an ``@``.
        """
        import regex as re

        upto, digit = re.compile(patterns.UP_TO_LAST_CUT), re.compile(patterns.DIGIT)
        text = self.tail + "".join(deltas)
        at, cut, cuts, ends = len(self.tail), 0, [], []
        for delta in deltas:
            last = upto.match(delta)
            cut = cut if last is None else at + len(last.group(1))
            at += len(delta)
            cuts.append(cut)
            ends.append(at)
        closed = self._ends(text[: cut + 1]) if cut else [[]] * len(self.settled)
        out, n = [], [0] * len(self.settled)
        for cut, end in zip(cuts, ends, strict=True):
            for t, places in enumerate(closed):
                while n[t] < len(places) and places[n[t]] <= cut:
                    n[t] += 1
            counts = [a + b for a, b in zip(self.settled, n, strict=True)]
            low = max(cut - 1, 0)
            if text.find("@", low, end) >= 0 or digit.search(text, low, end):
                counts = [a + len(b) for a, b in zip(counts, self._ends(text[low:end]), strict=True)]
            out.append(counts)
        if cut:
            self.settled = [a + b for a, b in zip(self.settled, n, strict=True)]
            self.tail = text[cut - 1 :]
        else:
            self.tail = text
        return out


def verify_stream(
    df: DataFrame,
    key: str | Sequence[str] = "session_id",
    seq: str = "seq",
    idle_timeout_ms: int | None = None,
    report_late: bool = False,
    is_last: str | None = None,
    reorder: int = 0,
    first_seq: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """Session key, ``seq``, ``action``, ``reason``, ``matched_rules`` for each batch.

    Exactly one verdict per row. Rows of a micro-batch are taken by ``seq``;
    between micro-batches arrival order counts, and ``report_late`` adds a column
    ``late`` for rows whose ``seq`` was already passed.

    ``reorder``: so many rows of a session may wait in its state for those before them, if
    its rows are numbered without gaps from ``first_seq``. When more wait, the first of
    them is judged although rows before it are missing; they count as late. When the
    session is silent for ``idle_timeout_ms`` all that wait are judged in order; without
    that they wait for the missing ones.

    ``buckets``: sessions share so many groups; see :func:`keyed_state`. The state of a session is its
    match counts and the text behind its last cut. A row whose ``is_last`` column is true
    gets its verdict and ends the session: its state goes, and later rows begin a new one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(
        *keys,
        seq,
        F.coalesce("text_delta", F.lit("")).alias("_delta"),
        F.coalesce(F.size("token_ids") > 0, F.lit(False)).alias("_ids"),
        (F.lit(False) if is_last is None else F.coalesce(F.col(is_last), F.lit(False))).alias("_last"),
    )
    types = dict(rows.dtypes)
    output = [(c, types[c]) for c in [*keys, seq]]
    output += [("action", "string"), ("reason", "string"), ("matched_rules", "array<string>")]
    output += [("late", "boolean")] * report_late
    names = list(patterns.PII_PATTERNS)

    fresh = ("", False, None, *[0] * len(names))

    def judged(key_values: tuple, held: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """(state, verdicts) after some rows."""
        tail, has_text, last, *settled = held
        out = []
        while rows:
            # up to the end of the session
            n = next((i + 1 for i, r in enumerate(rows) if r[3]), len(rows))
            some, rows = rows[:n], rows[n:]
            scanner = _Scanner(tail, settled)
            for (row_seq, delta, has_ids, _), counts in zip(some, scanner.add([r[1] for r in some]), strict=True):
                has_text = has_text or delta != ""
                matched = [t for t, k in zip(names, counts, strict=True) for _ in range(k)]
                if matched:
                    verdict = (BLOCK, REASON_PII, matched)
                elif has_ids and not has_text:
                    verdict = (FLAG, REASON_NO_TEXT, [NO_TEXT_RULE])
                else:
                    verdict = (PASS, REASON_OK, [])
                late = (last is not None and row_seq <= last,) if report_late else ()
                last = row_seq if last is None else max(last, row_seq)
                out.append((*key_values, row_seq, *verdict, *late))
            tail, has_text, last, *settled = fresh if some[-1][3] else (scanner.tail, has_text, last, *scanner.settled)
        return (tail, has_text, last, *settled), out

    def step(key_values: tuple, columns: Columns, state: tuple | None):
        held, waiting = (tuple(state[: len(fresh)]), state[len(fresh) :]) if state else (fresh, ())
        rows = list(zip(*[plain(columns[c]) for c in (seq, "_delta", "_ids", "_last")], strict=True))
        if reorder:
            rows = sorted([*zip(*waiting, strict=True), *rows], key=lambda r: r[0])
            n, last = 0, first_seq - 1 if held[2] is None else held[2]
            # what follows on is taken; if too many wait the first of them goes on, over the gap
            while n < len(rows) and (rows[n][0] <= last + 1 or len(rows) - n > reorder):
                last = max(last, rows[n][0])
                n += 1
            rows, late = rows[:n], rows[n:]
            waiting = [list(c) for c in zip(*late, strict=True)] if late else [[], [], [], []]
        new, verdicts = judged(key_values, held, rows)
        return None if new == fresh and not (waiting and waiting[0]) else (*new, *waiting), verdicts

    def left(key_values: tuple, state: tuple) -> list[tuple]:
        """Verdicts on what still waits when a session has been silent for too long."""
        return judged(key_values, tuple(state[: len(fresh)]), list(zip(*state[len(fresh) :], strict=True)))[1]

    state = _STATE + (f", _w_seq array<{types[seq]}>, _w_delta array<string>, _w_ids array<boolean>, _w_last array<boolean>" if reorder else "")
    return keyed_state(rows, keys, seq, step, output, state, idle_timeout_ms, left if reorder else None, buckets)
