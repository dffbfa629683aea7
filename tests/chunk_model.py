"""Chunkers and the similarity of titles on single values, step by step: what the expressions must return."""

import re

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
OPEN_END = re.compile(r"(?:[.!?]\s+|^)([^.!?]*)$")


def pack_sentences(text: str, size: int = 4000, overlap: int = 400) -> list[str]:
    """Greedy packing of sentences; a new chunk begins with the tail of the last one: what follows its last sentence end, else all of the tail."""
    out, now = [], ""
    for s in filter(None, SENTENCE_END.split(re.sub(r"\s+", " ", text).strip())):
        if now and len(now) + len(s) + 1 > size:
            out.append(now.strip())
            tail = now[-overlap:] if overlap else ""
            found = OPEN_END.search(tail)
            tail = found[1].strip() if found and found[1].strip() else tail.strip()
            now = tail + " " if tail else ""
        now += s + " "
    return [*out, now.strip()] if now.strip() else out


def cleaned(text: str, preserve_paragraphs: bool = True) -> str:
    """Line ends as \\n, runs of blanks as one, blank lines as one; without ``preserve_paragraphs`` blank lines between texts are blanks too."""
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"([^\n])[^\S\n]+([^\n])" if preserve_paragraphs else r"([^\n])\s+([^\n])", r"\1 \2", text)
    return re.sub(r"\n\s*\n\s*", "\n\n", text).strip()


def windows(text: str, size: int, overlap: int, legacy_suffix: bool = False) -> list[str]:
    """Cuts of ``size`` at a stride of size - overlap up to the first that reaches the end; a legacy suffix is one more cut within the last."""
    starts = range(0, len(text), size - overlap)
    last = next(k for k, a in enumerate(starts) if a + size >= len(text))
    return [text[a : a + size].strip() for a in (starts if legacy_suffix else starts[: last + 1])]


class _Packer:
    """Parts in one chunk; each is followed by a blank, which counts."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.out = size, overlap, []
        self.parts: list[str] = []
        self.length = 0

    def close(self) -> None:
        if self.length:
            self.out.append(" ".join(self.parts).strip())
        self.parts, self.length = [], 0

    def add(self, part: str) -> None:
        if self.length and self.length + len(part) > self.size:
            long, last = self.length > self.overlap, self.parts
            self.close()
            if long:
                kept = total = 0
                while kept < len(last) and total + len(last[-1 - kept]) <= self.overlap:
                    total, kept = total + len(last[-1 - kept]), kept + 1
                self.parts = last[len(last) - kept :]
                self.length = max(1, total + kept)  # the blank before the first part, if none is kept
        self.parts.append(part)
        self.length += len(part) + 1


def semantic_chunks(text: str, size: int = 1000, overlap: int = 200, preserve_paragraphs: bool = True, legacy_suffix: bool = False) -> list[str]:
    """Paragraphs, oversize ones as sentences, packed up to ``size`` with trailing whole parts of up to ``overlap`` again; oversize sentences are cut."""
    packer = _Packer(size, overlap)
    for paragraph in re.split(r"\n\s*\n", cleaned(text, preserve_paragraphs)):
        for part in [paragraph] if len(paragraph) <= size else SENTENCE_END.split(paragraph):
            if len(part) > size:
                packer.close()
                packer.out += windows(part, size, overlap, legacy_suffix)
            elif part:
                packer.add(part)
    packer.close()
    return [x for x in packer.out if x]


def break_chunks(text: str, size: int = 4000) -> list[str]:
    """Cuts after the last blank line, else the last sentence end, else hard, within each window; the last piece keeps its blanks."""
    out, at = [], 0
    while len(text) - at > size:
        window = text[at : at + size]
        end = next((at + cut + 2 for cut in (window.rfind("\n\n"), window.rfind(". ")) if cut > 0), at + size)
        out.append(text[at:end].strip())
        at = end
    return [x for x in (*out, text[at:]) if x]


def title_ratio(a: str, b: str) -> int:
    """0 to 100: twice the longest common subsequence over the lengths, by bit-parallel rows."""
    a, b = a.lower().strip(), b.lower().strip()
    if not a and not b:
        return 100
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for ch in b:
        u = row & places.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return round(200 * (len(a) - row.bit_count()) / (len(a) + len(b)))
