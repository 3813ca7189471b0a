"""Help for people who type queries: completions and samples."""

from __future__ import annotations

import re
from collections.abc import Iterable

from docspan.plans import syntax

KEYWORDS = (*syntax.VERBS, *syntax.TAILS)
OPERATORS = (*syntax.COMPARISONS, *syntax.TESTS, *syntax.UPDATES, *syntax.STAGES, *syntax.ACCUMULATORS)
MOST = 40
#: By title: queries over the collection, and one that joins orders with customers.
SAMPLES = {
    "Everything": "db.{col}.find().limit(20)",
    "Third page": "db.{col}.find().page(3, 25)",
    "A range": "db.{col}.find({ o_totalprice: { $gte: 1000, $lt: 50000 } })",
    "Either": 'db.{col}.find({ $or: [{ o_orderstatus: "F" }, { o_orderpriority: { $in: ["1-URGENT", "2-HIGH"] } }] })',
    "Text pattern": 'db.{col}.find({ p_name: { $regex: "^small" } }).project({ p_name: 1 })',
    "Largest first": "db.{col}.find().sort({ o_totalprice: -1 }).limit(10)",
    "How many": 'db.{col}.aggregate([{ $match: { o_orderstatus: "O" } }, { $count: "open" }])',
    "By group": 'db.{col}.aggregate([{ $group: { _id: "$o_orderstatus", n: { $sum: 1 }, mean: { $avg: "$o_totalprice" } } }])',
    "With matches": 'db.orders.aggregate([{ $lookup: { from: "customer", localField: "o_custkey", foreignField: "c_custkey", as: "buyer" } }, { $limit: 25 }])',
    "Change": 'db.{col}.update({ c_acctbal: { $lt: 0 } }, { $set: { owes: true }, $inc: { reminders: 1 } })',
    "Remove": "db.{col}.delete({ owes: { $exists: false } })",
}


def samples(collection: str = "orders") -> dict[str, str]:
    return {title: text.replace("{col}", collection or "orders") for title, text in SAMPLES.items()}


def completions(text: str, caret: int, collections: Iterable[str] = (), fields: Iterable[str] = ()) -> list[str]:
    """Words that go on from the one before the caret, in order, at most 40."""
    before = re.search(r"[\w$]*$", text[: max(0, caret)])[0].lower()
    words = {w for w in (*collections, *fields, *KEYWORDS, *OPERATORS) if w and w.lower().startswith(before)}
    return sorted(words, key=str.lower)[:MOST]
