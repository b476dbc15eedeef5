"""Raw records of each source as canonical rows. None: the record is skipped; an error is the caller's to isolate."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

Raw = dict
#: A canonical row: sections of law by citation, actions by their id.
RECORD = "kind string, key string, title string, action_type string, status string, agency string, day date, body string, refs array<string>, dockets array<string>"

# What the register's types and action texts are called, most specific first, and the agencies that count.
ACTION_TYPES = (
    ("Rule", "interim final", "interim_final_rule"),
    ("Rule", "direct final", "direct_final_rule"),
    ("Rule", "correction", "correction"),
    ("Rule", "withdrawal", "withdrawal"),
    ("Rule", "", "final_rule"),
    ("Proposed Rule", "advance notice", "advance_notice"),
    ("Proposed Rule", "", "proposed_rule"),
)
AGENCIES = {"federal-energy-regulatory-commission": "ferc", "environmental-protection-agency": "epa"}
CFR_AGENCIES = {18: "ferc", 40: "epa"}


def day_of(text: str | None) -> date | None:
    return date.fromisoformat(text) if text else None


def action_type(kind: str, text: str | None) -> str:
    text = (text or "").lower()
    return next((name for k, part, name in ACTION_TYPES if k == kind and part in text), "proposed_rule")


def row(kind: str, key: str, title: str, **more) -> dict:
    blank = {"action_type": None, "status": "approved", "agency": None, "day": None, "body": None, "refs": [], "dockets": []}
    return {"kind": kind, "key": key, "title": title} | blank | more


def cfr(raw: Raw) -> dict | None:
    title, part = raw["title_number"], raw["part"]
    number = raw.get("section_n_full") or f"{part}.{raw['section_number']}"
    return row("section", f"{title} CFR {number}", raw.get("heading") or "", agency=CFR_AGENCIES.get(int(title)), day=day_of(raw["amendment_date"]), body=raw.get("body_text") or "")


def iac(raw: Raw) -> dict | None:
    heading, body = raw.get("heading") or "", raw.get("body_text") or ""
    if not heading and not body:
        return None
    return row("section", raw["citation"], heading, status="repealed" if "(Repealed)" in heading else "approved", agency=raw.get("owning_agency"), day=day_of(raw["snapshot_date"]), body=body)


def federal_register(raw: Raw) -> dict | None:
    agency = next((AGENCIES[a["slug"]] for a in raw.get("agencies") or [] if a.get("slug") in AGENCIES), None)
    if agency is None:
        return None
    kind = raw.get("type") or ""
    refs = dict.fromkeys(f"{r['title']} CFR {r['part']}" for r in raw.get("cfr_references") or [] if r.get("title") is not None and r.get("part") is not None)
    return row("action", raw["document_number"], raw["title"], action_type=action_type(kind, raw.get("action")), status="in_progress" if kind == "Proposed Rule" else "approved", agency=agency, day=day_of(raw.get("publication_date")), body=raw.get("abstract"), refs=list(refs), dockets=raw.get("docket_ids") or [])


def commission_rulemaking(raw: Raw) -> dict | None:
    if not (key := raw.get("rm_number")):
        return None
    lsa = re.sub(r"\s+", "-", (raw.get("lsa_number") or "").strip()).upper()
    dockets = [key] + ([lsa if lsa.startswith("LSA-") else f"LSA-{lsa}"] if lsa else [])
    return row("action", key, raw.get("title") or key, action_type=raw.get("action_type") or "proposed_rule", status=raw.get("status") or "in_progress", agency="iurc", day=day_of(raw.get("date_published")), body=raw.get("abstract"), refs=raw.get("iac_refs") or [], dockets=dockets)


def board_rulemaking(raw: Raw) -> dict | None:
    if not (key := raw.get("lsa_id")):
        return None
    heading, kind = (raw.get("rule_heading") or "").strip(), (raw.get("pdf_type") or "").replace("_", " ")
    body = f"{heading} ({kind})" if heading and kind else heading or None
    return row("action", key, raw.get("title") or key, action_type=raw.get("action_type") or "rulemaking", status=raw.get("status") or "in_progress", agency="idem", day=day_of(raw.get("date_published")), body=body, refs=raw.get("iac_refs") or [], dockets=[key])


def general_order(raw: Raw) -> dict | None:
    if not (key := raw.get("gao_id")):
        return None
    return row("action", key, raw.get("title") or key, action_type="order", status=raw.get("status") or "approved", agency="iurc", day=day_of(raw.get("date_published")), body=raw.get("pdf_text") or None, dockets=[key])


def investigation(raw: Raw) -> dict | None:
    if not (key := raw.get("cause_number")):
        return None
    try:
        day = datetime.strptime(raw.get("date_filed") or "", "%m/%d/%Y").date()
    except ValueError:
        day = None
    return row("action", key, raw.get("title") or f"Cause {key}", action_type="commission_investigation" if raw.get("is_investigation") else "order", status="in_progress", agency="iurc", day=day, dockets=[key])


NORMALISERS: dict[str, Callable[[Raw], dict | None]] = {
    "cfr": cfr,
    "iac": iac,
    "federal_register": federal_register,
    "iurc_rulemakings": commission_rulemaking,
    "idem_rulemakings": board_rulemaking,
    "iurc_gaos": general_order,
    "iurc_investigations": investigation,
}
