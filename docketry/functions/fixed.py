"""What questions about gazette laws look like. Results are right only with exactly these values, so they stand
here as plain data, in natural order; all logic is elsewhere. Patterns are read with (?iU) unless said otherwise."""

from __future__ import annotations

# Law numbers as they are typed, the most specific form first (the second without ignoring case).
LAW_NUMBER_WRAPPED = r"\bKUV\s*-?\s*\d{1,2}\s*[-/_]?\s*[Ll]\s*-?\s*\d{1,4}\s*-?\s*[A-Z]+\b"
LAW_NUMBER = r"\b\d{1,2}\s*[-/_]?\s*[Ll]\s*-?\s*\d{1,4}[A-Za-z0-9-]*\b"
LAW_NUMBER_BY_YEAR = r"\b(?:19|20)\d{2}\s*[/_]\s*\d{1,3}\b"
# A law number without white space, in upper case: wrapper, series, number, suffix.
LAW_SHAPE = r"^(KUV-)?(\d{1,4})[-/]?L-?(\d{1,4})(-?[A-Z0-9]+)?$"
LAW_WRAPPED = r"^KUV-(\d{1,2}/L-\d{1,4})(?:-[A-Z0-9]+)?$"
# Law numbers as answers print them.
PRINTED_NUMBER = r"(?:KUV-)?\d{1,2}\s*/\s*[Ll]\s*-\s*\d{1,4}[A-Za-z0-9-]*|(?:19|20)\d{2}\s*/\s*\d{1,3}"

# Nouns for article, law and code, and their endings.
ARTICLE_STEM, ARTICLE_ENDINGS = "nen", "i it in et ve ës eve e".split()
LAW_STEMS, LAW_ENDINGS = ("ligj", "kod"), "i it in et ve ës eve e ave ore ash".split()
ARTICLE_ENGLISH = r"articles?"
ARTICLE_HEADER = r"(?:^|\n)\s*#{0,3}\s*Neni\s+(\d{1,4})\b"
HEADER_REACH, SOURCE_HEADER_REACH, RECOVERY_REACH, CITATION_GAP = 400, 500, 300, 40
NUMBER_SIGN = r"(?:\s*nr\.?\s*)?"
UNVERIFIED = " ⚠️ i paverifikuar"

# Laws that are cited by name or abbreviation, and their numbers; the first that is found counts.
NAMED_LAWS = (
    (r"\bkushtetut\w*", "KUSHTETUTA"),
    (r"\bkod\w*\s+(?:i\s+|t[ëe]\s+)?proced\w*\s+penal\w*|(?<![A-Za-z])KPPK?(?![A-Za-z])", "KUV-08/L-032-KOD"),
    (r"\bproced\w*\s+kontestimor\w*|(?<![A-Za-z])LPK(?![A-Za-z])", "03/L-006"),
    (r"\bkod\w*\s+penal\w*|(?<![A-Za-z])KPRK(?![A-Za-z])", "KUV-06/L-074-KOD"),
    (r"\bmarr[ëe]?d?h[ëe]?ni\w*\s+(?:e\s+|t[ëe]\s+)?detyrim\w*|lig\w*\s+(?:i\s+|p[ëe]r\s+)?detyrim\w*|(?<![A-Za-z])LMD(?![A-Za-z])", "04/L-077"),
    (r"\blig\w*\s+(?:i\s+|t[ëe]\s+|p[ëe]r\s+)?pun[ëe][sn]?\b", "03/L-212"),
    (r"\blig\w*\s+(?:i\s+|t[ëe]\s+|p[ëe]r\s+)?familj\w*", "2004/32"),
    (r"\blig\w*\s+(?:i\s+|t[ëe]\s+|p[ëe]r\s+)?trash[ëe]gimin?[ëe]?(?!\w*\s+kulturor)", "2004/26"),
)

# What asks whether a law is in force.
STATUS = ("aktiv", "abrogu", "shfuqizu", "zëvendësu", "zevendesu", "në fuqi", "ne fuqi", "ende", "fuqi", "vlen", "vlefsh", "valid")

# What opens a chat, and nothing else in the question.
GREETINGS = (
    "përshëndetje", "pershendetje", "tungjatjeta", "tung", "mirëdita", "mire dita", "mirëmëngjes", "mirembrema", "miremengjes", "hello", "hi", "hey",
    r"si\s+jeni", r"si\s+je", r"a\s+je\s+mir[ëe]?", r"a\s+jeni\s+mir[ëe]?", r"qysh\s+je(?:ni)?", r"si\s+po\s+(?:ja\s+)?kalon", "c'kemi", "qkemi", "ckemi", "ç'kemi",
)

# A place where no letter stands before, or after.
NO_LETTER_BEFORE, NO_LETTER_AFTER = "(?<![A-Za-zëçËÇ])", "(?![A-Za-zëçËÇ])"
# Subjects that are refused: cooking, private life, medicine, attacks.
OUT_OF_SCOPE = (
    NO_LETTER_BEFORE + "(?:recet|kuzhin|gatim)",
    NO_LETTER_BEFORE + "(?:dashuri|romanc)",
    NO_LETTER_BEFORE + "(?:mjekim|sëmundje|semundje|mjekësi|mjekesi)",
    r"\b(?:hack|exploit|crack|breach)\b",
)
# Law that no gazette text answers: another state, further states, union bodies, union treaties, theorists, confederations,
# federations, the world, covenants and conventions.
OUT_OF_CORPUS = (
    r"\bSHBA\b|\bUSA\b|shtetet?\s+e\s+bashkuara",
    NO_LETTER_BEFORE + "(?:franc[ëe]s|francez|belgjik|gjermani|britani|britanik|zvicr|amerikan)",
    r"bashkimi\s+evropian|\bUE\b|\bBE\b|parlament\w*\s+evropian|banka\s+qendrore\s+evropiane|gjykat\w*\s+e\s+drejt[ëe]sis[ëe]\s+s[ëe]\s+(?:ue|be)|komision\w*\s+evropian|kart\w*\s+(?:themelore|sociale)\s+\w*(?:evropian|europian|e\s+be)",
    r"traktat\w*\s+(?:i\s+)?(?:rom[ëe]s|mastrit|lisbon|nic[ëe]s|parisit|amsterdam|bruksel|kushtetues)|akti\s+unik\s+(?:evropian|europian)|plani\s+marshall|tregu\s+i\s+brend|ant[ëa]r[ëe]sim\w*\s+n[ëe]\s+bashk[ëe]si|trio\s+presidency|presidenc\w*\s+e\s+tresh",
    NO_LETTER_BEFORE + "(?:hartit|hobs|hobbes|kelzen|kelsen|akuin|benthamit|monteskje|rusoi)",
    NO_LETTER_BEFORE + "konfederat",
    r"shtet(?:e|et)\s+federativ|federaliz\w*",
    r"n[ëe]\s+bot[ëe]" + NO_LETTER_AFTER,
    r"pakti\s+nd[ëe]rkomb[ëe]tar|konvent\w*\s+(?:numer|nr)\.?\s*\d|drejt[ëe]s?\s+nd[ëe]rkomb[ëe]tar\w*\s+t[ëe]\s+pun",
)

# A law named by its series alone, and one whose number stops after the L.
SERIES_ALONE = r"ligj\w*\s+(?:(?:nr|num[ëe]r\w*)\.?\s*)?\d{1,2}(?!\s*[-/_]?\s*[Ll])(?!\d)"
SERIES_AND_L = r"ligj\w*\s+(?:(?:nr|num[ëe]r\w*)\.?\s*)?\d{1,2}\s*[-/_]\s*[Ll](?!\s*-?\s*\d)"
PARAGRAPH = r"(?:paragraf\w*|pik[ëeat]*)\s*\.?\s*\d{1,3}"

# How a question refers back: by a pronoun and a kind of text, by a paragraph, by asking for more.
REFERS_BACK = NO_LETTER_BEFORE + r"(?:k[ëe]tij|k[ëe]saj|atij|asaj|k[ëe]t[ëe]|at[ëe]|ky|kjo|ai|ajo|nj[ëe]jt\w*)\s+(?:nen|ligj|paragraf|pik|dispozit|kod)\w*"
PARAGRAPH_ALONE = NO_LETTER_BEFORE + PARAGRAPH
ASKS_FOR_MORE = NO_LETTER_BEFORE + (
    r"(?:(?:m[ëe]|me)\s+(?:shum[ëe]|tep[ëe]r|gjat[ëe]|holl[ëe]si|detaje)|thello\w*|zgjero\w*|elaboro\w*|shpjego\w*|sqaro\w*|vazhdo\w*|detaj\w*"
    r"|more|elaborate|explain\s+further|go\s+deeper|continue|expand)"
)
# A citation given as an example in brackets.
EXAMPLE = r"\(\s*(?:p\.?\s*sh\.?|p[ëe]r\s+shembull|e\.?\s*g\.?)[^)]*\)"

# Folded words that say nothing about a subject: question words, requests, what laws do, pronouns, particles, more, English.
FILLER_WORDS = (
    "cfare cfar cka ckfare qfare qfar qka qysh shka si kush cili cila cilat cilit kur ku sa pse perse "
    "trego tregom tregome tregoni jep jepme jepni shpjego shpjegoje sqaro spjego analizo interpreto "
    "thote thot thone thon flet flitet permban percakton percaktohet rregullon rregullohet trajton parashikon ndalon lejon specifikon "
    "ky kjo ai ajo kete keto ketij kesaj atij asaj ate njejtin "
    "i e te me mua na ma nje dhe per mbi rreth eshte esht a apo po do ka kane kan "
    "shume teper pak gjate hollesi detaje "
    "what does do say says tell show me explain of the article is are regulate define state provide about"
).split()
LAW_WORDS = "ligj ligji ligjit ligjin ligjet nr numer numri numrin law".split()

# What an answer says that refuses, in lower case.
REFUSAL_MARKERS = ("nuk kam informacion të mjaftueshëm", "do not have enough information")

# The questions that are asked of a topic, and the words that are no topic.
TOPIC_QUESTIONS = ("Cilat ligje rregullojnë {topic}?", "Cili ligj flet për {topic}?", "Cilat janë dispozitat ligjore për {topic}?", "Më trego ligjin që rregullon {topic}.", "Çfarë thotë legjislacioni për {topic}?")
TOPIC_STOPWORDS = (
    "neni", "ligji", "ligjit", "ligjin", "këtij", "kësaj", "është", "eshte", "mund", "kjo", "ky", "këto", "këta", "atë", "atij", "asaj", "këtu", "ketu", "këtë", "kete",
    "për", "per", "nga", "deri", "mbi", "para", "pasi", "pastaj", "thotë", "thote", "flet", "rregullon",
    "kosovës", "kosoves", "kosova", "republikës", "republikes", "personal", "organi", "pjesa", "rasti", "rastin",
)
