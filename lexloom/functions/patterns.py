"""Character classes in a notation that Java's and RE2's regular expressions read alike."""

# White space as Python's str.split and \s see it, for use inside brackets.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Kinds of spaces that become one plain space, and characters that are deleted.
SPACE_VARIANTS = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
CONTROL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{feff}]"
#: The same white space as characters.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"\p{L}\p{N}_"
URL = rf"(?i)https?://[^{WS}]+"
EMAIL = rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+"
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{WS}()-]{{7,}}\p{{Nd}}"
CARD = r"(?:^|[^\p{L}\p{N}_])(?:\p{Nd}[ -]?){13,19}(?:$|[^\p{L}\p{N}_])"
PIECE = rf"([{WS}]+|[^{WS}]+)"
