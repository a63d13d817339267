"""Which texts the tokenizer gets whole."""

from chatwarden.llm import token_files


def test_letters_that_end_like_white_space_are_not_searched(monkeypatch):
    class Searched:
        texts = []

        def search(self, text):
            self.texts.append(text)
            return token_files.re.search(r"\s |^ | $", text)

    monkeypatch.setattr(token_files, "_UNEVEN", Searched())
    encoder = token_files.WordEncoder.__new__(token_files.WordEncoder)
    encoder.special = []
    letters = [c.encode() + b" b" for c in ("café", "à", "straß", "ą", "完", "\U0001f60a")]
    assert not any(encoder._uneven(letters)) and not Searched.texts
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    assert all(encoder._uneven([f"a{c} b".encode() for c in spaces]))
    assert encoder._uneven([b"a b", b" a", b"a ", b""]) == [False, True, True, False]
