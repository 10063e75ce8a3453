"""Sigma rules: collections, modifiers and conditions, rewritten to native filters."""

from __future__ import annotations

import base64
import re

from tracequarry.rules.parse import Aggregate, Rule, RuleError, parse_filter

#: What a condition cannot express here.
UNSUPPORTED = (" avg ", " max ", " min ", " near ", " sum ")
#: Known value modifiers.
MODIFIERS = ("all", "base64", "base64offset", "contains", "endswith", "re", "startswith")


def base64_offsets(value: str) -> list[str]:
    """The parts of a value's base64 text that do not depend on what stands around it, at the three offsets."""
    out = []
    data = value.encode("utf-8")
    for offset, start in ((0, 0), (1, 2), (2, 3)):
        text = base64.b64encode(b" " * offset + data).decode("ascii")
        end = (None, -3, -2)[(len(data) + offset) % 3]
        out.append(text[start:end])
    return out


def _pattern(value, modifiers: list[str]):
    """The native value or values of one Sigma value under its modifiers."""
    if value is None:
        return None
    if isinstance(value, bool):
        text = str(value).lower()
    else:
        text = str(value)
    if "base64offset" in modifiers:
        return [f"*{v}*" for v in base64_offsets(text)]
    if "base64" in modifiers:
        text = base64.b64encode(text.encode("utf-8")).decode("ascii")
    if "re" in modifiers:
        return "?" + text
    if "contains" in modifiers:
        return f"i*{text}*"
    if "endswith" in modifiers:
        return f"i*{text}"
    if "startswith" in modifiers:
        return f"i{text}*"
    inner = text.strip("*")
    if "*" in inner or "?" in inner:
        body = re.escape(text).replace(r"\*", ".*").replace(r"\?", ".")
        return f"i?^{body}$"
    return "i" + text


def _entry(key: str, value) -> tuple[str, object]:
    name, *modifiers = key.split("|")
    unknown = sorted(set(modifiers) - set(MODIFIERS))
    if unknown:
        raise RuleError(f"unsupported modifiers: {', '.join(unknown)}")
    if isinstance(value, dict):
        return name, dict(_entry(k, v) for k, v in value.items())
    values: list = []
    for v in value if isinstance(value, list) else [value]:
        p = _pattern(v, modifiers)
        values.extend(p if isinstance(p, list) else [p])
    if "all" in modifiers:
        return f"all({name})", values
    return name, values if isinstance(value, list) or len(values) > 1 else values[0]


def _block(spec) -> object:
    if isinstance(spec, list):
        if not all(isinstance(x, dict) for x in spec):
            raise RuleError("values without a field are not supported")
        return [_block(x) for x in spec]
    if not isinstance(spec, dict):
        raise RuleError("values without a field are not supported")
    out: dict = {}
    for k, v in spec.items():
        if not k or k.startswith("|"):
            raise RuleError("values without a field are not supported")
        name, value = _entry(str(k), v)
        if name in out:  # the same field under several modifiers: all must hold
            if name.startswith("all("):
                value = [*out[name], *(value if isinstance(value, list) else [value])]
            else:
                first = out.pop(name)
                name, value = f"all({name})", [first, value]
        out[name] = value
    return out


def _spell(condition: str, names: list[str]) -> str:
    """A Sigma condition in the native grammar."""
    text = re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[1].lower(), condition)
    if any(x in f" {text} " for x in UNSUPPORTED) or "|" in text:
        raise RuleError(f"unsupported condition: {condition}")

    def group(m: re.Match) -> str:
        how, what = m.groups()
        if what == "them":
            hit = [n for n in names if not n.startswith("_")]
        elif what.endswith("*"):
            hit = [n for n in names if n.startswith(what[:-1])]
        else:
            hit = [n for n in names if n == what or re.fullmatch(re.escape(what) + r"_\d+", n)]
        if not hit:
            raise RuleError(f"{what!r} names no block in {condition!r}")
        return "(" + (" and " if how == "all" else " or ").join(hit) + ")"

    text = re.sub(r"\b(all|1) of ([\w*]+)", group, text)
    if " of " in text:
        raise RuleError(f"unsupported condition: {condition}")
    return text


def _aggregation(text: str) -> tuple[str, Aggregate | None]:
    """The condition without its ``| count() by g > n``, and the aggregate."""
    head, bar, tail = text.partition("|")
    if not bar:
        return text, None
    m = re.match(r"^\s*count\(\s*(\w[\w.]*)?\s*\)\s*(?:by\s+([\w.]+))?\s*(>=|<=|==|=|>|<)\s*(\d+)\s*$", tail)
    if not m:
        raise RuleError(f"unsupported aggregation: {tail.strip()}")
    fields = tuple(x for x in (m[1], m[2]) if x)
    return head.strip(), Aggregate("==" if m[3] == "=" else m[3], int(m[4]), fields)


def to_filter(detection: dict) -> tuple[dict, Aggregate | None]:
    """The native filter of a Sigma detection, and its aggregate."""
    condition = detection.get("condition")
    if isinstance(condition, list):
        if len(condition) != 1:
            raise RuleError("several conditions are not supported")
        condition = condition[0]
    if not condition:
        raise RuleError("a detection needs a condition")
    condition, aggregate = _aggregation(str(condition))
    blocks: dict = {}
    for name, spec in detection.items():
        if name not in ("condition", "timeframe"):
            blocks[str(name)] = _block(spec)
    return {"condition": _spell(condition, list(blocks)), **blocks}, aggregate


def _merge(base: dict, extension: dict) -> dict:
    out = dict(base)
    for k, v in extension.items():
        if k in out and k != "condition" and isinstance(out[k], dict) and isinstance(v, dict):
            out[k] = out[k] | v
        elif k in out and isinstance(out[k], list) and isinstance(v, dict):
            out[k] = [x | v for x in out[k]]
        elif k in out and isinstance(out[k], dict) and isinstance(v, list):
            out[k] = [out[k] | x for x in v]
        else:
            out[k] = v
    return out


def parse_sigma(spec: dict) -> Rule:
    if "detection" not in spec:
        raise RuleError("a Sigma rule needs a detection")
    body, aggregate = to_filter(spec["detection"])
    level = spec.get("level") if spec.get("level") in ("critical", "high", "medium", "low") else "info"
    status = spec.get("status") if spec.get("status") == "stable" else "experimental"
    authors = tuple(a.strip() for a in str(spec.get("author") or "unknown").split(",") if a.strip())
    meta = {k: spec[k] for k in ("id", "logsource", "references", "tags", "falsepositives") if k in spec}
    return Rule(
        str(spec.get("title", "")), "Sigma", "evtx", level, status, parse_filter(body), "timestamp", (), aggregate, str(spec.get("description", "")), authors, "sigma",
        meta | {"title": spec.get("title"), "level": level, "status": status, "filter": body},
    )


def load(text: str) -> list[Rule]:
    """The rules of one file; ``action: global`` documents are bases that the others extend."""
    import yaml

    base: dict = {}
    out = []
    documents = [d for d in yaml.safe_load_all(text) if d]
    extended = any(d.get("action") == "global" for d in documents)
    for d in documents:
        if d.get("action") == "global":
            base = {k: v for k, v in d.items() if k != "action"}
            continue
        merged = {**base, **d}
        if base:
            merged["detection"] = _merge(base.get("detection", {}), d.get("detection", {}))
        out.append(parse_sigma(merged))
    if extended and not out:
        out.append(parse_sigma(base))
    return out
