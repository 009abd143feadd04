"""English stop words: the usual list of 318, those that are made of others by a rule."""

from __future__ import annotations

#: Words and what is put behind them to make further stop words ("": nothing).
_MADE = {
    "here there where": ("", "after", "by", "in", "upon"), "any every no some": ("one", "thing", "where"), "any some": ("", "how"), "how what when who": ("", "ever"), "my her him it your": ("", "self"),
    "our them your": ("", "selves"), "her our your": ("s",), "become seem beside sometime toward": ("", "s"), "seem": ("ed", "ing"), "former latter most": ("", "ly"), "other": ("", "s", "wise"), "else": ("", "where"),
    "more": ("", "over"), "never": ("", "theless"), "after": ("", "wards"), "before": ("", "hand"), "through": ("", "out"), "with": ("", "in", "out"), "in on": ("", "to"), "up": ("", "on"), "can": ("", "not", "t"),
    "could has": ("", "nt"), "there": ("fore",), "where": ("as", "ver"), "any": ("way",), "no": ("", "body"), "six": ("", "ty"), "who": ("le", "m", "se"), "be": ("", "ing"),
}
# The other stop words.
_OTHERS = """
a about above across again against all almost alone along already also although always am among amongst amoungst amount an and another are around as at back became because becoming been behind below between
beyond bill both bottom but by call co con cry de describe detail do done down due during each eg eight either eleven empty enough etc even ever every except few fifteen fifty fill find fire first five for forty
found four from front full further get give go had have he hence his hundred i ie if inc indeed interest is its keep last least less ltd made many may me meanwhile might mill mine move much must name namely neither
next nine none nor not now of off often once one only or out over own part per perhaps please put rather re same see serious several she should show side since sincere so still such system take ten than that the
their then thence these they thick thin third this those though three thru thus to together too top twelve twenty two un under until us very via was we well were whence whether which while whither why will would yet you
"""

STOP_WORDS = tuple(sorted({word + end for words, ends in _MADE.items() for word in words.split() for end in ends} | set(_OTHERS.split())))
