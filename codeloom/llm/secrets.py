"""Secret scans: all rules in one automaton, one pass over the bytes."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Dfa, scan
from .shared import found_rows, parts, replace_column, with_ids


@dataclass(frozen=True)
class Rule:
    """A pattern of ``automaton``'s syntax.

    With ``bounded``, it must not follow a letter, digit or underscore; with ``closed``, none may follow it.
    Patterns without ``closed`` take all signs that a secret may go on with, or name the sign that ends it.
    ``sign``, if given, is a beginning of every match that the automaton of all rules looks for: secrets whose
    bodies hold signs after which another may start would need too many states there.
    """

    name: str
    pattern: str
    bounded: bool = True
    closed: bool = True
    sign: str | None = None

    def regex(self) -> str:
        """The same rule for a leftmost-first engine; rules are written so that both find the same matches."""
        flag, body = ("(?i)", self.pattern[4:]) if self.pattern.startswith("(?i)") else ("", self.pattern)
        return flag + (r"\b" if self.bounded else "") + f"(?:{body})" + (r"\b" if self.closed else "")


def _with_digit(other: str, least: int) -> str:
    """A pattern for ``least`` or more digits and signs of a class without digits, at least one of them a digit."""
    both = f"[0-9{other[1:]}"
    out = f"{other}*[0-9]{both}*"
    for n in range(least - 1):
        out = f"(?:[0-9]{both}{{{n + 1},}}|{other}{out})"
    return out


#: A private key's text through its END line; without one, its header and the base64 lines after it.
_PEM = "-----{} (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = "(?:[ \\t\\r\\n]|\\\\[nr])"
_KEY_REST = f"(?:(?:-{{0,4}}[^-])*{_PEM.format('END')}|(?:{_BREAK}*[A-Za-z0-9+/=]{{16,}})+(?:{_BREAK}+[A-Za-z0-9+/=]{{1,15}})?)?"
#: A name that ends like one of a secret; a quoted value of 16 signs, or 8 with a digit; an unquoted one of 16 with a digit.
_NAME = "(?i)[a-z0-9_]*(?:token|secret|password|passwd|(?:api|access|secret|private)[_-]?key)[\"']?"
_TO = "(?::=|=>|[:=])"
_QUOTED = f"[\"'](?:[!#-&(-~]{{16,}}|{_with_digit('[!#-&(-/:-~]', 8)})[\"']"
_BARE = f"{_with_digit('[a-z_/+.~%!$^*@-]', 16)}=?=?"
#: A password ends at the last @ of the URL's authority.
_SCHEME = "(?:https?|ftps?|postgres(?:ql)?|mysql|mariadb|mongodb(?:\\+srv)?|rediss?|amqps?)://"

RULES = (
    Rule("aws-access-key", "(?:AKIA|ASIA)[0-9A-Z]{16}"),
    Rule("github-token", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("gitlab-token", "glpat-[A-Za-z0-9_-]{20,}(?:\\.[0-9a-z]{2}\\.?[0-9a-z]{7})?", closed=False, sign="glpat-"),
    Rule("google-api-key", "AIza[0-9A-Za-z_-]{35,}", closed=False, sign="AIza"),
    Rule("slack-token", "xox[abprs]-[0-9A-Za-z]{8,}(?:-[0-9A-Za-z]{8,})*"),
    Rule("stripe-key", "(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{24}"),
    Rule("npm-token", "npm_[A-Za-z0-9]{36}"),
    Rule("json-web-token", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", closed=False),
    Rule("private-key", _PEM.format("BEGIN") + _KEY_REST, bounded=False, closed=False, sign=_PEM.format("BEGIN")),
    Rule("url-password", f"{_SCHEME}[^ \\t\\r\\n/?#:@\"'<>`]*:[^ \\t\\r\\n/?#\"'<>`]+@", closed=False, sign=f"{_SCHEME}[^ \\t\\r\\n/?#:@\"'<>`]*:"),
    Rule("assigned-secret", f"{_NAME}(?:\\s*{_TO}\\s*{_QUOTED}|[ \\t]*{_TO}[ \\t]*{_BARE})", closed=False, sign=f"{_NAME}\\s*[:=]"),
)

FOUND = "rule string, match_no int, start int, secret string"
_FOUND = [("rule", pa.string()), ("match_no", pa.int32()), ("start", pa.int32()), ("secret", pa.string())]
#: Bytes that are scanned at once; a longer text is scanned by itself.
STEP_BYTES = 2 << 20

_WORD_BYTE = np.array([chr(b).isalnum() and b < 128 or b == 95 for b in range(256)])


class Scanner:
    """The rules' automaton, and one exact automaton for each rule to find where a match begins and ends."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Dfa([r.sign or r.pattern for r in rules], search=True, bounded=[r.bounded for r in rules])
        self.each = [Dfa([r.pattern], search=False) for r in rules]
        self._accepting = np.array([bool(a) for a in self.all.accepts])

    def flagged(self, texts: list[bytes]) -> dict[int, int]:
        """Text number -> a bit for each rule that may have a match in it, by one pass over all bytes."""
        data = np.frombuffer(b"\xff".join(texts), np.uint8)
        if not len(data):
            return {}
        states = scan(self.all, data) // self.all.width
        out: dict[int, int] = {}
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for at in np.flatnonzero(self._accepting[states]).tolist():
            i = int(np.searchsorted(begin, at, "right")) - 1
            out[i] = out.get(i, 0) | self.all.accepts[states[at]]
        return out

    def matches(self, text: bytes, k: int) -> Iterator[tuple[int, int]]:
        """Byte ranges of rule k's leftmost-longest matches that don't overlap."""
        dfa, rule = self.each[k], self.rules[k]
        data = np.frombuffer(text, np.uint8)
        word = _WORD_BYTE[data]
        may = dfa.next[dfa.classes[data]] != (dfa.dead if dfa.dead is not None else -1)
        if rule.bounded:
            may[1:] &= ~word[:-1]
        table, classes, done = dfa.next, dfa.classes.tolist(), 0
        for start in np.flatnonzero(may).tolist():
            if start < done:
                continue
            s, end = 0, -1
            for at in range(start, len(text)):
                s = int(table[s + classes[text[at]]])
                if s == dfa.dead:
                    break
                if dfa.accepts[s // dfa.width] and not (rule.closed and at + 1 < len(text) and word[at + 1] and word[at]):
                    end = at + 1
            if end > start:
                yield start, end
                done = end

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, rule number, first character, end) of every match."""
        encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        start = 0
        while start < len(encoded):
            end, size = start + 1, len(encoded[start])
            while end < len(encoded) and size + len(encoded[end]) <= STEP_BYTES:
                size += len(encoded[end])
                end += 1
            for i, bits in sorted(self.flagged(encoded[start:end]).items()):
                text = encoded[start + i]
                #: Characters that begin before each byte: one sum for all of a text's matches.
                before = None if text.isascii() else np.cumsum(np.append(0, (np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                for k in range(len(self.rules)):
                    if bits >> k & 1:
                        for a, b in self.matches(text, k):
                            yield (start + i, k, a, b) if before is None else (start + i, k, int(before[a]), int(before[b]))
            start = end


@functools.cache
def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The scanner of some rules, made once in a process; the driver makes it and sends it to the executors."""
    return Scanner(rules)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule, match_no, start, secret): every match of every rule in every row.

    Matches of one rule don't overlap and are numbered from 1 by place; start counts characters from 0; matches
    of different rules may overlap. Null and empty texts have none, and an empty table no rows; texts of any length
    are scanned whole. Rows with a null id are scanned, repeated rows are reported each; ids keep their type; other
    columns are not read.
    """

    sent = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in parts(batches, 1):
            texts, ids, rows, last, no = batch.column(1).to_pylist(), batch.column(0), [], None, 0
            for i, k, a, b in scanner.find(texts):
                no = no + 1 if last == (i, k) else 1
                last = i, k
                rows.append((i, rules[k].name, no, a, texts[i][a:b]))
            yield found_rows(ids, rows, _FOUND)

    rows, schema = with_ids(docs, id_col, text_col, FOUND)
    return rows.mapInArrow(run, schema)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret replaced by ``[SECRET:rule]``; the same rows and columns.

    Overlapping matches are replaced together under the rule of the first. length_col, if docs has it, gets the
    new length of changed texts. Null and empty texts, repeated rows and columns of any name stay as they are; an empty
    table stays empty.
    """
    length_col = length_col if length_col in docs.columns else None

    sent = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in parts(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            by_text: dict[int, list[tuple[int, int, int]]] = {}
            for i, k, a, b in scanner.find(texts):
                by_text.setdefault(i, []).append((a, b, k))
            if by_text:
                sizes = batch.column(length_col).to_pylist() if length_col else []
                for i, found in by_text.items():
                    out, done = [], 0
                    for a, b, k in sorted(found):
                        if a >= done:
                            out += [texts[i][done:a], f"[SECRET:{rules[k].name}]"]
                        done = max(done, b)
                    texts[i] = "".join([*out, texts[i][done:]])
                    if length_col:
                        sizes[i] = len(texts[i])
                batch = replace_column(batch, text_col, texts)
                if length_col:
                    batch = replace_column(batch, length_col, sizes)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def oracle(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``secrets``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.name)}, {quote(r.regex())})" for r in rules)
    each = " UNION ALL ".join(f"SELECT doc_id, {quote(r.name)} AS rule, text, regexp_extract_all(text, {quote(r.regex())}) AS found, string_split_regex(text, {quote(r.regex())}) AS rest FROM {table} WHERE text IS NOT NULL" for r in rules)
    return f"""WITH rules(rule, pattern) AS (VALUES {values}), hit AS (SELECT * FROM ({each}) WHERE len(found) > 0),
one AS (SELECT doc_id, rule, found, rest, unnest(range(1, len(found) + 1)) AS no FROM hit)
SELECT doc_id, rule, CAST(no AS INTEGER) AS match_no,
  CAST(list_sum(list_transform(rest[1:no], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:no - 1], lambda x: length(x))), 0) AS INTEGER) AS start,
  found[no] AS secret
FROM one"""
