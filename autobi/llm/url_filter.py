"""URL filter: domain and path rules, and a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common


def terms(path: str | None = None) -> dict[str, int]:
    """Weights by term, from lines of a term, a tab and its weight; by default the list that comes with this package."""
    if path:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    else:
        text = resources.files("autobi.llm").joinpath("url_terms.tsv").read_text("utf-8")
    pairs = (line.split("\t") for line in text.splitlines() if line.strip() and not line.startswith("#"))
    return {term.encode().lower().decode(): int(weight) for term, weight in pairs}


#: The weight at which a URL is rejected: terms that have it alone are strict, the others soft.
LIMIT = 2
#: Rules of the registered query, (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].encode().lower().decode(), path[:stop]


class Rules:
    """Longest matching (host, path prefix) rule; of equal ones, the blocking one."""

    def __init__(self, rules):
        self.paths: dict[str, dict[str, str]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            own = self.paths.setdefault(host, {})
            if own.get(slash + path) != "block":
                own[slash + path] = verdict
        self.sizes = {host: sorted({len(p) for p in own}, reverse=True) for host, own in self.paths.items()}

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            suffix = host[at:]
            for size in self.sizes.get(suffix, ()):
                if size <= len(path) and (verdict := self.paths[suffix].get(path[:size])):
                    if best is None or len(suffix) + size > len(best[0]):
                        best = suffix + path[:size], verdict
                    break
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


class Vocabulary:
    """Terms are compared byte by byte; A-Z count as a-z."""

    def __init__(self, weights: Mapping[str, int]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.machine.add_word(term.encode().decode("latin-1"), (weight, term))
        self.machine.make_automaton()

    def hits(self, url: str) -> dict[str, int]:
        """Distinct terms with their weights that stand between bytes other than a-z and 0-9."""
        text = url.encode().lower().decode("latin-1")
        found: dict[str, int] = {}
        inner = lambda c: c.isascii() and c.isalnum()
        for last, (weight, term) in self.machine.iter(text) if len(self.machine) else ():
            first = last - len(term.encode()) + 1
            if (first == 0 or not inner(text[first - 1])) and (last + 1 == len(text) or not inner(text[last + 1])):
                found[term] = weight
        return found


def url_filter(pages: DataFrame, rules=RULES, weights: Mapping[str, int] | None = None, limit: int = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, n_strict, n_soft)`` of each URL.

    A rule decides if one fits, of equal rules the blocking one; otherwise a URL is blocked if its distinct terms
    weigh ``limit`` or more together: one strict term (of that weight alone), or several soft ones. A null URL, or one
    without ``://``, has empty host and path; a null one has no terms and is allowed. Rules and terms are sent to
    every task: they are configuration of known size. Null ids are kept. Repeated rows each give a row; other columns
    are not read; an empty table gives an empty result.
    """
    rules, weights = tuple(rules), dict(terms() if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = Rules(rules), Vocabulary(weights)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = own.find(host, path)
                found = list(words.hits(url or "").values())
                verdict = rule[1] if rule else "block" if sum(found) >= limit else "allow"
                strict = sum(w >= limit for w in found)
                rows.append((host, path, rule and rule[0], verdict, strict, len(found) - strict))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(common.read(spark, sf_dir, "pages"))
