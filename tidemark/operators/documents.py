"""Documents around a study: protocol, data policy, strategy, decision, walk-forward report and report manifest.

Each kind is a table of rules (path, test, what must hold); `problems` gives every rule that a document breaks, `accept`
raises on any. A path part ending in [] stands for all items of a list. Documents are small and live on the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from datetime import date
from pathlib import Path
from typing import Any

from tidemark.operators import lifecycle

Rule = tuple[str, Callable[[Any], bool], str]
MISSING = object()

# Names that documents must use.
COSTS = ("zero", "baseline", "double")
COST_KEYS = {f"{name}_bps_per_side" for name in COSTS}
WINDOWS = ("development", "outer_test", "retention")
CAPABILITIES = {
    "historical_daily_ohlcv", "historical_minute_ohlcv", "corporate_actions", "delisted_instruments",
    "symbol_changes", "bid_ask", "point_in_time_listing_reference", "historical_sector_history",
}
METRICS = ("trades", "win_rate", "profit_factor", "sharpe", "mean_net_bps", "total_net_pnl", "max_drawdown_frac")
DECISIONS = ("Candidate", "No-Go")


def canonical(document: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest(document: Any) -> str:
    return hashlib.sha256(canonical(document).encode()).hexdigest()


def found(document: Any, path: str) -> Iterator[Any]:
    """Values at a path; MISSING where there is none."""
    head, _, rest = path.partition(".")
    name = head.removesuffix("[]")
    value = document.get(name, MISSING) if isinstance(document, dict) else MISSING
    items = [value] if name == head else value if isinstance(value, list) and value else [MISSING]
    for item in items:
        if rest:
            yield from found(item, rest)
        else:
            yield item


def text(v: Any) -> bool:
    return isinstance(v, str) and bool(v.strip())


def number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def count(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v > 0


def texts(v: Any) -> bool:
    return isinstance(v, list) and bool(v) and all(map(text, v))


def some(kind: type) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, kind) and bool(v)


def day(v: Any) -> bool:
    try:
        return bool(date.fromisoformat(v))
    except (TypeError, ValueError):
        return False


def sha(v: Any) -> bool:
    return isinstance(v, str) and bool(re.fullmatch(r"[0-9a-f]{64}", v))


def has(*names: str, only: bool = False) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, dict) and (set(v) == set(names) if only else set(names) <= set(v))


def is_(*values: Any) -> Callable[[Any], bool]:
    return lambda v: any(type(v) is type(x) and v == x for x in values)


def all_of(test: Callable[[Any], bool]) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, dict) and bool(v) and all(map(test, v.values()))


def each(prefix: str, names: str, test: Callable[[Any], bool], what: str) -> list[Rule]:
    return [(f"{prefix}{name}", test, what) for name in names.split()]


VERSION: list[Rule] = [("schema_version", is_(1), "must be 1")]
PROTOCOL: list[Rule] = [
    *VERSION, ("protocol_id", text, "must be text"), *each("", "declared_at retention_available_after", day, "must be a date"),
    ("date_windows", has(*WINDOWS, only=True), f"must hold exactly {', '.join(WINDOWS)}"),
    *(r for w in WINDOWS for r in each(f"date_windows.{w}.", "start end", day, "must be a date")),
    ("experiment_budget", all_of(count), "must hold positive integers"),
    *each("validation.", "train_days validation_days outer_test_days step_days", count, "must be a positive integer"),
    *each("validation.", "purge_days embargo_days", lambda v: v == 0 or count(v), "must be an integer of 0 or more"),
    ("validation.random_seed_required", is_(True), "must be true"),
    ("costs", has(*COST_KEYS, only=True), "must hold zero, baseline and double"), ("costs", all_of(lambda v: number(v) and v >= 0), "must not be negative"),
    ("random_seeds", all_of(lambda v: isinstance(v, int) and not isinstance(v, bool)), "must hold integers"),
    ("gates", all_of(number), "must hold numbers"), ("invalidation_rules", texts, "must be a list of texts"),
]
POLICY: list[Rule] = [
    *VERSION, ("policy_id", text, "must be text"), ("decision", is_("selected_with_blockers"), "must select sources with blockers"),
    *(r for s in ("primary", "fallback") for r in (
        (f"{s}.provider", text, "must be text"), (f"{s}.capabilities", has(*CAPABILITIES, only=True), "must name every capability"),
        (f"{s}.capabilities", all_of(lambda v: isinstance(v, bool)), "must be true or false"), (f"{s}.source_urls", texts, "must be a list of texts"),
    )),
    ("universe.membership_basis", is_("point_in_time_listing_intervals"), "must be listing intervals"), ("universe.symbol_is_alias_only", is_(True), "must be true"),
    ("universe.interval_end_semantics", is_("exclusive"), "must be exclusive"), ("universe.minimum_history_start", day, "must be a date"),
    *each("universe.", "minimum_daily_universe_size minimum_regime_years minute_subset_max_size", count, "must be a positive integer"),
    *each("universe.", "market identity_key", text, "must be text"), ("universe.asset_types", texts, "must be a list of texts"),
    *each("licensing.", "credentials_from_environment_only raw_data_commit_forbidden", is_(True), "must be true"),
    *each("", "blockers prohibited_shortcuts", texts, "must be a list of texts"),
]
STRATEGY: list[Rule] = [
    *VERSION, *each("", "spec_id strategy_family hypothesis", text, "must be text"), ("universe.point_in_time", is_(True), "must be true"),
    *each("features[].", "name source as_of transform", text, "must be text"), *each("label.", "name definition", text, "must be text"),
    ("label.horizon_days", count, "must be a positive integer"), ("label.cost_included", is_(True), "must be true"),
    *each("holding_period.", "min_days max_days", count, "must be a positive integer"), ("holding_period.overnight_allowed", is_(True, False), "must be true or false"),
    ("parameters.search_space_hash", sha, "must be a SHA-256"), ("parameters.declared", some(dict), "must not be empty"),
    ("costs.scenarios", has(*COST_KEYS, only=True), "must hold zero, baseline and double"), ("costs.scenarios", all_of(lambda v: number(v) and v >= 0), "must not be negative"),
    ("costs.commission_model", text, "must be text"), ("protocol.protocol_id", text, "must be text"), ("protocol.protocol_hash", sha, "must be a SHA-256"),
    ("data.manifest_hash", sha, "must be a SHA-256"), ("data.snapshot_id", text, "must be text"),
    *each("experiment_budget.", "max_parameter_trials max_model_trials", count, "must be a positive integer"), ("invalidation", texts, "must be a list of texts"),
]
DECISION: list[Rule] = [
    *VERSION, *each("", "report_id code_commit", text, "must be text"), ("decision.state", text, "must be text"), ("decision.reasons", texts, "must be a list of texts"),
    *each("decision.gates[].", "name status", text, "must be text"), *each("decision.gates[].", "threshold observed", number, "must be a number"),
    ("evidence", some(dict), "must not be empty"),
]
REPORT: list[Rule] = [
    *VERSION, ("generated_at", text, "must be text"), ("folds", lambda v: v is not MISSING, "is missing"),
    ("fold_definition", has("train_days", "test_days", "step_days"), "must hold train, test and step days"),
    ("selection_gates", has("min_trades", "min_train_sharpe", "min_train_pf", "validation"), "must hold every gate"),
    ("decision_gates", has("min_outer_trades", "min_outer_sharpe", "min_outer_pf"), "must hold every gate"),
    *((f"outer_test_metrics_by_cost.{c}", has(*METRICS), "must hold every metric") for c in COSTS),
    ("decision", is_(*DECISIONS), f"must be one of {', '.join(DECISIONS)}"), ("decision_reasons", lambda v: isinstance(v, list), "must be a list"),
    ("symbol_attribution_baseline", some(dict), "must not be empty"), ("input_meta[]", some(dict), "must be a list of objects"),
]


def _protocol(d: dict) -> list[str]:
    at = [(date.fromisoformat(d["date_windows"][w]["start"]), date.fromisoformat(d["date_windows"][w]["end"])) for w in WINDOWS]
    wrong = [f"date_windows.{w}: ends before it starts" for w, (a, b) in zip(WINDOWS, at, strict=True) if b < a]
    wrong += [f"date_windows: {v} and {w} overlap" for v, w, a, b in zip(WINDOWS, WINDOWS[1:], at, at[1:], strict=False) if a[1] >= b[0]]
    late = date.fromisoformat(d["retention_available_after"]) > at[-1][1]
    return wrong + ([] if late else ["retention_available_after: must follow the retention window"])


def _policy(d: dict) -> list[str]:
    wrong = [] if d["primary"]["provider"].lower() != d["fallback"]["provider"].lower() else ["fallback.provider: must differ from the primary one"]
    return wrong + (["primary.capabilities: one that is lacking must be shown"] if all(d["primary"]["capabilities"].values()) else [])


def _strategy(d: dict) -> list[str]:
    return [] if d["holding_period"]["min_days"] <= d["holding_period"]["max_days"] else ["holding_period: min_days exceeds max_days"]


def _report(d: dict) -> list[str]:
    own = lifecycle.grid_hash(lifecycle.grid())
    return [] if d["input_meta"][0].get("grid_spec_hash") == own else [f"input_meta: the grid's hash must be {own}"]


KINDS = {"protocol": (PROTOCOL, _protocol), "policy": (POLICY, _policy), "strategy": (STRATEGY, _strategy), "decision": (DECISION, lambda d: []), "report": (REPORT, _report)}


def problems(document: Any, kind: str) -> list[str]:
    """Rules that the document breaks; those across fields are tested once every single field is right."""
    rules, across = KINDS[kind]
    wrong = list(dict.fromkeys(f"{path}: {what}" for path, test, what in rules for v in found(document, path) if not test(v)))
    return wrong or across(document)


def accept(document: dict, kind: str) -> str:
    """The document's hash; ValueError with all problems if there are any."""
    if wrong := problems(document, kind):
        raise ValueError(f"{kind}: " + "; ".join(wrong))
    return digest(document)


def accept_decision(document: dict, strategy: dict, states: tuple[str, ...] | None = None) -> str:
    """As `accept`, and the decision must belong to the strategy as declared, its hashes and budget included."""
    own = accept(document, "decision")
    due = {
        "spec_id": strategy["spec_id"], "strategy_family": strategy["strategy_family"], "spec_hash": accept(strategy, "strategy"),
        "protocol_hash": strategy["protocol"]["protocol_hash"], "data_manifest_hash": strategy["data"]["manifest_hash"], "experiment_budget": strategy["experiment_budget"],
    }
    if wrong := [k for k, v in due.items() if document.get(k) != v]:
        raise ValueError(f"decision: not as declared by the strategy: {', '.join(wrong)}")
    if states and document["decision"]["state"] not in states:
        raise ValueError(f"decision: state must be one of {', '.join(states)}")
    return own


def create_only(path: str | Path, content: str) -> Path:
    """Write a file whole or not at all; FileExistsError if it is there."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, prefix=".new-", encoding="utf-8") as draft:
        draft.write(content)
        draft.flush()
        os.link(draft.name, path)
    return path


def summary(document: dict) -> str:
    """A decision as text."""
    lines = [f"# {document['report_id']}: {document['decision']['state']}", "", *(f"* {k}: {document.get(k)}" for k in ("spec_id", "strategy_family", "spec_hash", "protocol_hash", "data_manifest_hash", "code_commit")), ""]
    lines += [f"* {reason}" for reason in document["decision"]["reasons"]]
    lines += ["", "| gate | threshold | observed | status |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {g['name']} | {g['threshold']} | {g['observed']} | {g['status']} |" for g in document["decision"]["gates"]]) + "\n"


def manifest_status(path: str | Path) -> dict[str, Any]:
    """State of a report manifest and of the files beside it: passed, failed or, with no file present, not-run."""
    path, bad = Path(path), []
    try:
        listed = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        return {"manifest": "failed", "reports": "not-run", "entries": 0, "present": 0, "missing": 0, "problems": [f"unreadable: {e}"]}
    reports = next(found(listed, "reports"))
    entries = reports if isinstance(reports, list) else []
    head = [] if next(found(listed, "schema_version")) == 1 else ["schema_version: must be 1"]
    head += [] if entries else ["reports: must not be empty"]
    names, files = set(), {True: 0, False: 0}
    for i, e in enumerate(entries):
        if not has("filename", "kind", "generated_at", "sha256")(e):
            bad.append(f"reports {i}: fields are missing")
        elif not text(e["filename"]) or Path(e["filename"]).name != e["filename"] or e["filename"] in names:
            bad.append(f"reports {i}: filename must be plain and occur once")
        elif not sha(str(e["sha256"]).lower()):
            bad.append(f"reports {i}: sha256 must be a SHA-256")
        else:
            names.add(e["filename"])
            file = path.parent / e["filename"]
            files[file.exists()] += 1
            if file.exists():
                bad += _file_problems(file, e)
    if files[True] and files[False]:
        bad.append("reports: only some are present")
    state = "failed" if bad else "passed" if files[True] else "not-run"
    return {"manifest": "failed" if head + bad else "passed", "reports": state, "entries": len(entries), "present": files[True], "missing": files[False], "problems": head + bad}


def _file_problems(file: Path, entry: dict) -> list[str]:
    with file.open("rb") as stream:
        if hashlib.file_digest(stream, "sha256").hexdigest() != entry["sha256"].lower():
            return [f"{file.name}: SHA-256 differs"]
    if entry["kind"] != "wf_select":
        return []
    try:
        return [f"{file.name}: {p}" for p in problems(json.loads(file.read_text(encoding="utf-8")), "report")]
    except ValueError as e:
        return [f"{file.name}: not JSON: {e}"]
