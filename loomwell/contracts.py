"""Closed schemas, manifests, question sets and the states of a review."""

from __future__ import annotations

import ast
import hashlib
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions import text as t
from loomwell.operators.audit import IntegrityError

SHA256 = re.compile(r"[0-9a-f]{64}")


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame in the schema's column order; a column too many or too few, or of another type, is an error."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    wrong = [f"missing {n}" for n in want if n not in have] + [f"unknown {n}" for n in have if n not in want] + [f"{n} is {have[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    if wrong:
        raise IntegrityError("; ".join(sorted(wrong)))
    return df.select(*schema.fieldNames())


def require_keys(values: dict, keys: set[str], where: str = "object") -> dict:
    if set(values) != keys:
        raise IntegrityError(f"{where}: missing {sorted(keys - set(values))}, unknown {sorted(set(values) - keys)}")
    return values


def inside(path: str, folder: str) -> str:
    """An existing or new path that may not leave its folder, not even by links."""
    if os.path.isabs(path) or not path or "\\" in path:
        raise IntegrityError(f"not a relative path: {path!r}")
    full = os.path.realpath(os.path.join(folder, path))
    if os.path.commonpath([full, os.path.realpath(folder)]) != os.path.realpath(folder):
        raise IntegrityError(f"{path!r} leads out of its folder")
    return full


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def verify_manifest(manifest: dict, folder: str) -> dict[str, str]:
    """Check the sources of a manifest, ``{"sources": [{source_id, path, bytes, sha256}]}``; digests by source."""
    out = {}
    for s in require_keys(manifest, {"sources"}, "manifest")["sources"]:
        require_keys(s, {"source_id", "path", "bytes", "sha256"}, "source")
        if not SHA256.fullmatch(s["sha256"]) or s["source_id"] in out:
            raise IntegrityError(f"bad digest or repeated source: {s['source_id']}")
        path = inside(s["path"], folder)
        if os.path.getsize(path) != s["bytes"] or file_digest(path) != s["sha256"]:
            raise IntegrityError(f"{s['source_id']} is not the source that the manifest names")
        out[s["source_id"]] = s["sha256"]
    return out


def question_violations(questions: DataFrame, id_pattern: str = r"[0-9]+\.[0-9]+[a-z]?") -> DataFrame:
    """Rules that questions break: question_id, problem, part (nullable), position, query_text, query_text_sha256, ground_truth_available."""
    from loomwell.operators.review import violations

    return violations(questions, "question_id", {
        "id_has_form": t.full_match(F.col("question_id"), id_pattern),
        "id_is_problem_and_part": F.col("question_id") == F.concat("problem", F.coalesce("part", F.lit(""))),
        "text_not_blank": t.word_count(F.col("query_text")) > 0,
        "digest_is_of_text": F.col("query_text_sha256") == t.fingerprint(F.col("query_text")),
        "ground_truth_hidden": ~F.col("ground_truth_available"),
    })


def score_cell(source: str, name: str = "scores") -> dict:
    """The literal that a cell of a scoring sheet assigns to ``name``; nothing in the cell is run."""
    tree = ast.parse(source)
    found = [n.value for n in tree.body if isinstance(n, ast.Assign) and [getattr(x, "id", None) for x in n.targets] == [name]]
    if len(found) != 1 or len(tree.body) != 1:
        raise IntegrityError(f"the cell has to be one assignment to {name}")
    got = ast.literal_eval(found[0])
    if not isinstance(got, dict):
        raise IntegrityError(f"{name} is no dictionary")
    return got


class ReviewState:
    """States of reference answers: pre_approval, approved, frozen; the file's digest decides which one holds.

    The ledger keeps the digest of each state that was reached. A file that is
    none of them has been changed outside and every step is refused.
    """

    ORDER = ("pre_approval", "approved", "frozen")

    def __init__(self, path: str, ledger: str):
        self.path, self.ledger = path, ledger
        if not os.path.exists(ledger):
            self._write({self.ORDER[0]: file_digest(path)})

    def _read(self) -> dict:
        with open(self.ledger, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, values: dict) -> None:
        with open(self.ledger + ".tmp", "w", encoding="utf-8") as f:
            json.dump(values, f, sort_keys=True)
        os.replace(self.ledger + ".tmp", self.ledger)

    def state(self) -> str:
        now = file_digest(self.path)
        for name, digest in reversed(sorted(self._read().items(), key=lambda x: self.ORDER.index(x[0]))):
            if digest == now:
                return name
        raise IntegrityError("the file is in no recorded state")

    def advance(self, content: bytes) -> str:
        """Replace the content and go to the next state, keeping a copy of what was there."""
        state = self.state()
        if state == self.ORDER[-1]:
            raise IntegrityError("what is frozen can't be changed")
        step = self.ORDER[self.ORDER.index(state) + 1]
        copy = f"{self.path}.{state}"
        if not os.path.exists(copy):  # an earlier try may have ended after this
            os.link(self.path, copy)
        elif file_digest(copy) != file_digest(self.path):
            raise IntegrityError(f"{copy} is no copy of the file")
        with open(self.path + ".tmp", "wb") as f:  # a new file: the copy keeps what was there
            f.write(content)
        self._write(self._read() | {step: hashlib.sha256(content).hexdigest()})
        os.replace(self.path + ".tmp", self.path)
        return step
