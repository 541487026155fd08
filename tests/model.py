"""A plain Python model of whole-text masking, for tests only."""

from __future__ import annotations

import re

from maskwright.config import MaskingConfig
from maskwright.functions import registry as reg

AGE_YEAR = 2025


def rx(source: str, ignore_case: bool = False) -> re.Pattern:
    return re.compile(source, re.ASCII | (re.IGNORECASE if ignore_case else 0))


def mask(function: str, v: str, strategy: str) -> str:
    """The partial, full and structural masks that the fixtures below need."""
    stars = "*" * len(v)
    digits = re.sub(r"\D", "", v)
    if function == "email":
        local, domain = v.split("@")[:2]
        if strategy == "structural":
            return f"{'*' * len(local)}@{'*' * len(domain)}"
        if strategy == "full":
            return "***@***.***"
        shown = local[0] + "*" * (len(local) - 2) + local[-1] if len(local) > 2 else "***"
        labels = domain.split(".")
        return f"{shown}@{labels[0][:1]}***.{labels[-1]}" if len(labels) > 1 else f"{shown}@***"
    if function == "phone":
        m = re.match(r"\+?\d{1,3}[-.\s]?", v)
        prefix = m.group() if m else ""
        rest = v[len(prefix) :]
        if strategy == "structural":
            return prefix + re.sub(r"\d", "*", rest)
        if strategy == "full":
            return "***"
        own = re.sub(r"\D", "", rest)
        return prefix + ("***" if len(own) <= 2 else "*" * (len(own) - 2) + own[-2:])
    if function == "address" and strategy != "structural":
        return "[ADDRESS REDACTED]"
    fixed = {"tfn": "*** *** ***", "abn": "** *** *** ***"}
    if function in fixed and strategy != "structural":
        return fixed[function]
    if strategy == "structural":
        return stars
    if strategy == "full":
        return "***-**-****" if function == "ssn" else "*.*.*.*" if function == "ip" else _dob_full(v) if function == "dob" else "***"
    if function == "ssn":
        parts = v.split("-")
        return "***-**-" + parts[2] if len(parts) == 3 else "***"
    if function == "card":
        groups = re.findall(r"\d{4}", v)
        return "**** " * (len(groups) - 1) + digits[-4:] if groups and len(digits) >= 4 else "***"
    if function == "dob":
        sep = next((s for s in "-/. " if s in v), "-")
        if re.search(r"[A-Za-z]", v):
            return f"**{sep}***{sep}{re.split(r'[-/. ]+', v)[2]}"
        a, _, c = v.split(sep)
        return f"{a}{sep}**{sep}**" if len(a) == 4 else f"**{sep}**{sep}{c}"
    if function == "national_id":
        return v[:2] + "*" * (len(v) - 4) + v[-2:] if len(v) > 4 else "***"
    if function == "bsb":
        sep = "-" if "-" in v else " " if " " in v else ""
        return f"***{sep}*{digits[5]}" if len(digits) == 6 else "***"
    if function == "account":
        return "***" + digits[-3:] if len(digits) >= 3 else "***"
    if function == "ip":
        return v.split(".")[0] + ".*.*.*" if ":" not in v else v.split(":")[0] + ":" + "*" * 10
    return v[0] + "*" * (len(v) - 2) + v[-1] if len(v) > 3 else "***"


def _dob_full(v: str) -> str:
    sep = next((s for s in "-/. " if s in v), "-")
    if re.search(r"[A-Za-z]", v):
        return f"**{sep}***{sep}****"
    return f"****{sep}**{sep}**" if len(v.split(sep)[0]) == 4 else f"**{sep}**{sep}****"


def plausible(v: str) -> bool:
    from datetime import date

    parts = re.split("[-/]", v)
    if len(parts) != 3:
        return False
    y, m, d = parts if len(parts[0]) == 4 else reversed(parts)
    try:
        date(int(y), int(m), int(d))
    except ValueError:
        return False
    return 18 <= AGE_YEAR - int(y) <= 120


def anomaly(v: str, type_: str) -> float:
    if re.search(r"(\d)\1{4}", v):
        return 0.2
    runs = ["0123456789"[i : i + 4] for i in range(7)] + ["7890"] + ["9876543210"[i : i + 4] for i in range(7)]
    if type_ not in reg.SEQUENCES_ALLOWED and any(r in re.sub(r"\D", "", v) for r in runs):
        return 0.3
    if re.match(r"XXXX|0000|N/A|TBD|TODO|test|example|dummy|placeholder|sample", v, re.I):
        return 0.1
    word = re.sub(r"\W", "", v, flags=re.ASCII)
    return 0.15 if len(word) > 2 and len(set(word)) == 1 else 1.0


def decided(t: str, at: int, v: str, d: reg.Detector, cfg: MaskingConfig) -> float | None:
    """The confidence if the candidate passes every gate."""
    end = at + len(v)
    b300, a50 = t[max(0, at - 300) : at], t[end : end + 50]
    if b300.rfind("<") > b300.rfind(">") and ">" in a50:
        return None
    if '"' in b300 and re.match(r'\s*"?\s*:', a50):
        return None
    b, a = t[max(0, at - 100) : at], t[end : end + 100]
    if d.type == "dateOfBirth" and not (any(w in b.lower() for w in reg.BIRTH_WORDS) and plausible(v)):
        return None
    odd = anomaly(v, d.type)
    context = t[max(0, at - 100) : end + 100].lower()
    score = d.prior
    if odd < 0.5:
        score = odd * 0.5
    else:
        for words, by in ((reg.POSITIVE_WORDS, 0.1), (reg.NEGATIVE_WORDS, -0.3), (reg.FIELD_WORDS, 0.2)):
            if any(w in context for w in words):
                score += by
        score = max(0.0, min(1.0, score))
    if re.search(r"<[^>]+>\s*\Z", b) and re.match(r"\s*</", a):
        need = cfg.confidence_threshold - 0.1
    elif re.search(r'[{,]\s*"[^"]+"\s*:\s*"?\s*\Z', b):
        need = cfg.confidence_threshold - 0.1
    elif re.search(r",\s*\Z", b) or re.match(r"\s*,", a):
        need = cfg.confidence_threshold
    else:
        need = cfg.confidence_threshold + 0.15
    need += 0.1 * (d.type in reg.HIGH_RISK)
    need += {"strict": 0.1, "manual": 0.2}.get(cfg.mode, 0.0)
    return score if score >= max(0.5, min(0.95, need)) else None


def overlaps(a: int, b: int, s: int, e: int) -> bool:
    return s <= a < e or s < b <= e or (a <= s and b >= e)


def cdata(inner: str, cfg: MaskingConfig) -> list[tuple[str, int, int]]:
    kept: list[tuple[str, int, int]] = []
    for d in reg.REGISTRY.not_disabled(cfg.effective_types()):
        for m in rx(d.source, d.ignore_case).finditer(inner):
            if m.start() and "\n" not in m.group() and not any(overlaps(m.start(), m.end(), s, e) for _, s, e in kept):
                kept.append((d.type, m.start(), m.end()))
    return kept


def place(t: str, at: int) -> tuple[int, int]:
    before = t[:at]
    return before.count("\n") + 1, at - before.rfind("\n") - 1


def mask_text(t: str, cfg: MaskingConfig) -> tuple[str, list[tuple]]:
    """(masked text, detections as (type, original, masked, line, column))."""
    types = cfg.effective_types()
    claimed: set[str] = set()
    edits: list[tuple[int, int, str]] = []
    out: list[tuple] = []
    ranges: list[tuple[int, int]] = []
    is_xml = bool(re.search(r"<[^>]+>", t))
    if is_xml or re.match(r"\s*[\[{]", t) or re.search(r'"[^"]+"\s*:', t):
        for m in re.finditer(r"<([^>\s/]+)>\s*<!\[CDATA\[([\s\S]*?)\]\]>\s*</\1>", t):
            inner = m.group(2)
            kept = cdata(inner, cfg)
            if not inner.strip() or inner in claimed or not kept:
                continue
            at = m.start() + m.group().index(inner)
            masked = list(inner)
            for kind, s, e in kept:
                masked[s:e] = "*" * (e - s)
                out.append((kind, inner[s:e], "*" * (e - s), *place(t, at + s)))
            claimed.add(inner)
            edits.append((at, len(inner), "".join(masked)))
            ranges.append((at, at + len(inner)))
        for source in (r'"([^"]+)"\s*:\s*"([^"]+)"', r'"([^"]+)"\s*:\s*([0-9\s-]+)', r"<([^>\s/]+)>([^<]+)</\1>"):
            for m in re.finditer(source, t, re.ASCII):
                name, v = m.groups()
                kind = reg.column_type(name)
                if v in claimed or not v.strip() or types.get(kind) is False:
                    continue
                at = t.index(v, m.start())
                shown = mask(reg.MASKS.get(kind, "generic"), v, cfg.strategy)
                out.append((kind, v, shown, *place(t, at)))
                claimed.add(v)
                edits.append((at, len(v), shown))
    for d in reg.REGISTRY.enabled(types):
        for m in rx(d.source, d.ignore_case).finditer(t):
            v, at = m.group(), m.start()
            if v in claimed or decided(t, at, v, d, cfg) is None or any(overlaps(at, m.end(), s, e) for s, e in ranges):
                continue
            shown = mask(d.mask, v, "structural" if is_xml else cfg.strategy)
            out.append((d.type, v, shown, *place(t, at)))
            claimed.add(v)
            edits.append((at, len(v), shown))
    for p in cfg.custom_patterns:
        for m in rx(p.pattern).finditer(t) if p.enabled else ():
            if m.group() not in claimed:
                out.append(("custom", m.group(), p.replacement, *place(t, m.start())))
                claimed.add(m.group())
                edits.append((m.start(), len(m.group()), p.replacement))
    for same in (True, False):
        for at, n, shown in sorted((e for e in edits if (len(e[2]) == e[1]) is same), key=lambda e: -e[0]):
            t = t[:at] + shown + t[at + n :]
    return t, out
