"""A reader of made-up documents: a first line with title and password, then pages parted by form feeds; ``!`` begins a broken page."""


class Document:
    def __init__(self, head: str, pages: list[str]):
        self.title, self.pages = head, pages

    def __len__(self):
        return len(self.pages)

    def text(self, k):
        if self.pages[k].startswith("!"):
            raise RuntimeError("broken page")
        return self.pages[k]

    def png(self, k, dpi):
        return f"png {k} {dpi}".encode()


def open_pdf(file, password=None):
    raw = file.read().decode()
    if not raw.startswith("%FAKE"):
        raise ValueError("not a document")
    head, _, rest = raw.partition("\n")
    _, title, word = head.split("|")
    if word and word != password:
        raise PermissionError("wrong password")
    return Document(title, rest.split("\f"))
