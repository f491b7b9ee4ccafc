"""Small helpers for tests: brute-force twins of set operators and workbook files."""

import zipfile
from xml.sax.saxutils import escape


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def ratio(a, b):
    return 1.0 if a == b else 1 - edit_distance(a, b) / max(len(a), len(b))


def duplicates_by_hand(rows):
    """{record_id: (peer place, strategy, score)} by comparing row with row, batch by batch."""
    found = {}
    groups = {}
    for r in rows:
        groups.setdefault((r["batch_id"], r["entity_type"]), []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: r["row_ord"])
        for kind in ("email", "code"):
            holder = {}
            for r in group:
                key = r[f"key_{kind}"]
                if key and holder.setdefault(key, r) is not r and r["record_id"] not in found:
                    found[r["record_id"]] = (holder[key]["row_ord"], f"{kind}_exact", 1.0)
        rest = [r for r in group if r["key_name"] and r["record_id"] not in found]
        for i, r in enumerate(rest):
            close = (p for p in rest[:i] if ratio(r["key_name"], p["key_name"]) >= 0.85)
            peer = next(close, None)
            if peer:
                found[r["record_id"]] = (
                    peer["row_ord"], "name_fuzzy", ratio(r["key_name"], peer["key_name"]))
    return found


def letters(n):
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(path, sheets, merges=()):
    """A minimal workbook. Cells: str, int/float, bool, None, ('date', n), ('formula', v),
    ('rich', [..]), ('error', text)."""
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if isinstance(v, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        kind, value = v
        if kind == "date":
            return f'<c r="{ref}" s="1"><v>{value}</v></c>'
        if kind == "formula":
            got = "" if value is None else f"<v>{value}</v>"
            return f'<c r="{ref}"><f>A1</f>{got}</c>'
        if kind == "rich":
            runs = "".join(f"<r><t>{escape(t)}</t></r>" for t in value)
            return f'<c r="{ref}" t="inlineStr"><is>{runs}</is></c>'
        return f'<c r="{ref}" t="e"><v>{value}</v></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        entries = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>'
                          for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{entries}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
                        for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, name in enumerate(names, 1):
            rows = "".join(
                f'<row r="{r}">' + "".join(cell(f"{letters(c)}{r}", v) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(sheets[name], 1) if row is not None)
            joined = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
            tail = f"<mergeCells>{joined}</mergeCells>" if joined else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml",
                       f"<worksheet {ns}><sheetData>{rows}</sheetData>{tail}</worksheet>")
