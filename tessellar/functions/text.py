"""Text functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no content in a search
SEARCH_STOPWORDS = (
    "a an and are as at be been but by can did do does for from had has have how i if in into is it its me of on or our "
    "out so than that the their them then there these they this to up was we were what when where which who whom why "
    "will with would you your about after all also any because before between both could each give just like make many "
    "more most much must no not only other over own same should some such take very want well while"
).split()

# fixed values: what a document says when it speaks to the model (Java regex, case-insensitive)
INJECTION = "|".join(
    (
        r"ignore\s+(?:all\s+|any\s+)?(?:the\s+|your\s+|previous\s+|prior\s+|above\s+)*(?:instructions?|prompts?|rules?|directions?)",
        r"disregard\s+(?:all\s+)?(?:the\s+|your\s+)?(?:instructions?|prompts?|rules?)",
        r"forget\s+(?:everything|all)\s+(?:you|above|before|prior)",
        r"you\s+are\s+now\s+(?:a|an|the)\b",
        r"(?:new|updated|revised)\s+(?:system\s+)?(?:instructions?|prompt|rules?)\s*:",
        r"system\s*(?:prompt|message)\s*:",
        r"\bassistant\s*:\s",
        r"\buser\s*:\s",
        r"always\s+(?:answer|respond|reply|say)\s",
        r"(?:do\s+not|don't|never)\s+(?:cite|use|mention|reference)\b",
        r"reveal\s+(?:your|the)\s+(?:system\s+)?(?:prompt|instructions?)",
    )
)


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased ASCII identifiers, their camel-case and snake-case parts, numbers without commas.

    Identifiers of one letter are left out; so are parts of one letter or equal to their identifier.
    """
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)

    def parts(w: Column) -> Column:
        pieces = F.regexp_extract_all(w, F.lit(r"([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"), 1)
        return F.filter(F.transform(pieces, lambda p: F.lower(p)), lambda p: (F.length(p) > 1) & (p != F.lower(w)))

    def named(names: Column) -> Column:
        words = F.filter(F.transform(names, lambda w: F.lower(w)), lambda w: F.length(w) > 1)
        # only a name with an underscore, or a capital after its first letter, has parts of its own
        made = F.filter(names, lambda w: w.rlike("_|.[A-Z]"))
        return F.concat(words, F.flatten(F.transform(made, parts)))

    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)+|[0-9]+)"), 1), lambda n: F.replace(n, F.lit(","), F.lit("")))
    # through a lambda, so that the names are found once
    return F.concat(F.flatten(F.transform(F.array(found), named)), numbers)


def content_terms(text: Column) -> Column:
    """Distinct tokens of two letters or more that are not stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in SEARCH_STOPWORDS])
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))


def numeric_heavy(text: Column) -> Column:
    """Whether at least half of the lines with text (and at least one) are numeric.

    A line is numeric if it has 8 characters or more without white space and either no
    letter or half of them are digits or of ``. , - + e E``.
    """
    lines = F.filter(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), lambda s: s.rlike(r"(?U)\S"))

    def numeric(line: Column) -> Column:
        body = F.regexp_replace(line, r"(?U)\s+", "")
        return (F.length(body) >= 8) & (
            ~body.rlike(r"\p{L}") | (F.length(F.regexp_replace(body, r"[^0-9.,+eE\-]", "")) * 2 >= F.length(body))
        )

    count = F.size(F.filter(lines, numeric))
    return F.coalesce((count > 0) & (count * 2 >= F.size(lines)), F.lit(False))


def cleaned(text: Column) -> Column:
    """Without byte-order mark, no-break spaces as spaces, runs of blanks as one, at most one empty line, trimmed."""
    out = F.regexp_replace(text, "^﻿+", "")
    out = F.regexp_replace(F.replace(out, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """For comparing facts: white space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"(?U)\s+", " ")))


def token_estimate(text: Column) -> Column:
    """Word pieces, where no tokenizer is at hand: a quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")


def has_injection(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){INJECTION}")


def fenced(text: Column) -> Column:
    """Role lines (``user:``) as ``user_``, so that a passage cannot pose as a turn."""
    return F.regexp_replace(text, r"(?im)^(\s*)(system|assistant|user|human)\s*:\s*", "$1$2_")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def citations(text: Column) -> Column:
    """Cited numbers in order, repeats kept; ASCII, fullwidth and CJK brackets and digits."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\[［【]([0-9０-９]{1,3})[\]］】]"), 1)
    return F.transform(found, lambda n: ascii_digits(n).cast("int"))


def url_key(url: Column) -> Column:
    """Key under which URLs are one page: scheme, lower-cased host, unquoted path without last slashes; no query, no fragment."""
    path = F.rtrim(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.concat(
        F.coalesce(F.parse_url(url, F.lit("PROTOCOL")), F.lit("")),
        F.lit("://"),
        F.lower(F.coalesce(F.parse_url(url, F.lit("AUTHORITY")), F.lit(""))),
        F.when(plain == "", "/").otherwise(plain),
    )


#: White space of any kind and every dash that is set for a hyphen.
PHRASE_GAP = r"[\s\-\x{2010}-\x{2015}]+"


def phrase_pattern(term: str) -> str | None:
    """Java regex for a term as a document may space it: words of the term, any gap between, word ends at word edges."""
    words = [w for w in re.split(r"[\s\-\u2010-\u2015]+", term.strip()) if w] or ([term.strip()] if term.strip() else [])
    if not words:
        return None
    edge = lambda c: r"\b" if c.isalnum() or c == "_" else ""
    quoted = PHRASE_GAP.join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return f"{edge(words[0][0])}{quoted}{edge(words[-1][-1])}"


def spans(text: Column, pattern: str) -> Column:
    """``[start, end)`` in code points of every match, as structs: pieces between the matches tell where they are."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda m: F.length(m))
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda gap, own: F.struct(gap.alias("gap"), own.alias("own")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["own"]).alias("at"),
            F.concat(
                s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["own"]).alias("end")))
            ).alias("out"),
        ),
        lambda s: s["out"],
    )


def confidence(score: Column, returned: Column) -> Column:
    return (
        F.when(returned == 0, "none").when(score >= 0.5, "high").when(score >= 0.35, "medium").otherwise("low")
    )


# fixed values: whole messages that need no document
GREETINGS = (
    "hi|hii|hey|hello|hallo|yo|hiya|howdy|heya|sup|hi there|hiya there|hello there|hey there|good morning|good evening|"
    "good afternoon|good day|how are you|how are you doing|how's it going|hows it going|how are things|whats up|what is up|"
    "what's up|nice to meet you"
).split("|")
SMALL_TALK = (
    "thanks|thank you|thanks a lot|thank you so much|cheers|bye|goodbye|see you|good night|goodnight|ok|okay|cool|nice|great|"
    "got it|understood|perfect|lol|thx|thank u|many thanks|thanks so much|appreciate it|awesome|amazing|wow|good job|great job|"
    "well done|nice one|that is great|thats great|that's great|that is awesome|that is perfect|sounds good|makes sense|i see|"
    "alright|all right|no worries|no problem|take care|see you later|have a nice day"
).split("|")
ASSISTANT = (
    "who are you|who r u|who are u|who r you|what are you|what r you|what is you|whats your name|what's your name|"
    "what is your name|tell me about yourself|tell me about you|introduce yourself|who am i talking to|what can you do|"
    "what can you do for me|what do you do|how can you help me today|how you can help me today|how can you help me|"
    "how you can help me|how can you help|how you can help|how can i use you|what can i ask you|what should i ask|"
    "how do you work|what is this app|how can i help you|are you human|are you a human|are you a bot|are you ai|"
    "are you a robot|are you chatgpt|help me|help"
).split("|")
ASSISTANT_FORM = (
    r"^(?:who (?:are|r|is) (?:you|u)|what (?:are|r|is) (?:you|u)|what can (?:you|u) do|what can (?:you|u) help(?: me)?(?: with)?|"
    r"how (?:can (?:you|u)|(?:you|u) can) help(?: me)?(?: with)?|what do (?:you|u) do|tell me about (?:yourself|you)|"
    r"how do (?:you|u) work|how can i use (?:you|u))(?: today| please| really| anyway| at all)?$"
)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9']+", " "))


def intent(message: Column) -> Column:
    """``greeting``, ``small_talk``, ``assistant`` or ``question``.

    Social only if the whole message is a known phrase, or every piece between commas,
    stops and "and", "then", "plus" is; a piece about the assistant, then a greeting, wins.
    """
    text = F.coalesce(message, F.lit(""))

    def kind(phrase: Column) -> Column:
        return (
            F.when(phrase.isin(GREETINGS), "greeting")
            .when(phrase.isin(SMALL_TALK), "small_talk")
            .when(phrase.isin(ASSISTANT) | phrase.rlike(ASSISTANT_FORM), "assistant")
        )

    pieces = F.filter(F.transform(F.split(F.lower(text), r"[,;.!?]+|\b(?:and|then|plus)\b", -1), _plain), lambda p: p != "")
    kinds = F.transform(pieces, lambda p: F.coalesce(kind(p), F.lit("question")))
    social = (F.size(kinds) > 1) & ~F.array_contains(kinds, "question")
    by_piece = (
        F.when(~social, "question")
        .when(F.array_contains(kinds, "assistant"), "assistant")
        .when(F.array_contains(kinds, "greeting"), "greeting")
        .otherwise("small_talk")
    )
    return F.coalesce(kind(_plain(text)), by_piece)


# fixed values: replies to messages that ask nothing of the sources
REPLIES = {
    "greeting": (
        "Hello. Ask me anything about this notebook's sources and I will answer from the passages, with the exact text cited. "
        "Nothing I write here comes from outside your documents."
    ),
    "small_talk": "Any time. Ask me a question about these sources whenever you are ready.",
    "assistant": (
        "I am the research assistant for this notebook. I answer from the documents indexed here rather than from outside knowledge, "
        "and I cite the passage behind each claim - add a document and ask me about it."
    ),
}
EMPTY_REPLY = (
    "This notebook has no sources yet, so there is nothing to answer from. Add a PDF, DOCX, Markdown or CSV file and I can answer "
    "questions about it."
)


def reply_for(kind: Column) -> Column:
    """The reply to a message of this kind without a search; to any other kind, that there are no sources."""
    known = F.create_map(*[F.lit(x) for pair in REPLIES.items() for x in pair])
    return F.coalesce(known[kind], F.lit(EMPTY_REPLY))
