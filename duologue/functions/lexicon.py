"""Word lists that lexical measures count.

Fixed values: the lists and the tag pattern below must hold exactly these entries for measure
values to be comparable; they are stated as they are, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LSM_CATEGORIES: dict[str, list[str]] = {
    "personal_pronouns": "i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself they them their theirs themselves".split(),
    "impersonal_pronouns": "it its itself this that these those which who whom whose what anything something nothing everything anyone someone everyone nobody any some none all".split(),
    "articles": "a an the".split(),
    "conjunctions": "and but or nor for yet so because although though while whereas since unless until whether if then also plus".split(),
    "prepositions": "in on at by for with about against between into through during before after above below to from up down out off over under near across behind beyond within without around among".split(),
    "auxiliary_verbs": "am is are was were be been being have has had do does did will would shall should can could may might must ought".split(),
    "adverbs": "very really quite rather just still already always never ever often sometimes usually maybe perhaps probably actually basically literally totally completely almost nearly here there now then again once twice ago yet anymore though anyway instead".split(),
    "negations": "no not never none nobody nothing nowhere neither nor cannot cant dont doesnt didnt wont wouldnt shouldnt couldnt isnt arent wasnt werent havent hasnt hadnt".split(),
    "quantifiers": "much many more most less least few little lots plenty several enough half double twice each every both".split(),
}
FILLERS = "um uh erm er ah eh hmm mm uhm umm".split()
DISCOURSE_MARKERS = ["like", "you know", "i mean", "sort of", "kind of", "well", "so", "right"]
HEDGES = ["maybe", "perhaps", "possibly", "probably", "might", "could", "seems", "sort of", "kind of", "i think", "i guess", "i suppose", "i feel like", "a bit", "a little", "somewhat", "fairly", "pretty much", "more or less"]
GRATITUDE = ["thank", "thanks", "thank you", "appreciate", "grateful"]
APOLOGY = ["sorry", "apologize", "my bad", "excuse me", "forgive"]
GREETING = ["hi", "hello", "hey", "good morning", "good afternoon"]
PLEASE = ["please"]
POSITIVE = "good great nice wonderful excellent lovely amazing awesome fantastic happy glad love like enjoy fun interesting cool beautiful perfect brilliant delightful pleasant".split()
NEGATIVE = "bad terrible awful horrible hate dislike annoying boring stupid ugly worst sad angry upset difficult hard painful unfortunate".split()
AGREEMENT = ["yes", "yeah", "yep", "exactly", "absolutely", "definitely", "totally", "agreed", "true", "right", "of course", "for sure", "same"]
FIRST_PERSON_SINGULAR = "i me my mine myself im ive id ill".split()
FIRST_PERSON_PLURAL = "we us our ours ourselves weve were wed well".split()
SECOND_PERSON = "you your yours yourself yourselves youre youve youd youll".split()
COGNITIVE_VERBS = "think thought believe know knew feel felt realise realize wonder guess remember understand suppose imagine consider".split()
EMOTION_WORDS = "happy sad angry excited nervous anxious scared afraid proud embarrassed lonely grateful frustrated relieved worried calm content upset thrilled miserable delighted".split()
WH_WORDS = "who what when where why how which whose whom".split()
YES_NO_OPENERS = "is are was were do does did can could will would should have has had am may might must shall".split()
TAG_QUESTION = r"(?i)\b(right|yeah|no|okay|ok|isn'?t it|aren'?t you|don'?t you|doesn'?t it|wouldn'?t you|haven'?t you|didn'?t you|you know)\s*\?\s*$"
BACKCHANNELS = (
    "mhm mm mmm hmm hm uhhuh uhuh mmhm mhmm yeah yep yup yes ok okay right sure true wow oh ah aha huh nice cool exactly totally "
    "really definitely absolutely gotcha isee ohwow ohreally thatsright ofcourse makessense interesting no nope god jesus damn geez"
).split()
#: Words of referring back and of everyday talk, which do not make a topic.
REFERENCE_WORDS = (
    "remind reminds reminded mention mentions mentioned mentioning talk talked talking speak spoke speaking bring brought bringing describe described describing "
    "discuss discussed discussing earlier before previously already stuck keep kept sounds sound seemed react reacted reaction answer answered ask asked asking "
    "point points sense agree agreed suppose supposed guess guessed thinking wonder wondered story stories"
).split()
COMMON_WORDS = (
    "get got go goes going went come came make made take took see saw say said tell told want wanted think thought know knew like liked thing things stuff way lot bit "
    "yeah yes no okay ok right well one two three really just also even back then than that there here now"
).split()
#: End of the fixed values.

VOCABULARIES = LSM_CATEGORIES | {
    "fillers": FILLERS, "discourse_markers": DISCOURSE_MARKERS, "hedges": HEDGES, "gratitude": GRATITUDE, "apology": APOLOGY, "greeting": GREETING, "please": PLEASE, "positive": POSITIVE,
    "negative": NEGATIVE, "agreement": AGREEMENT, "first_person_singular": FIRST_PERSON_SINGULAR, "first_person_plural": FIRST_PERSON_PLURAL, "second_person": SECOND_PERSON,
    "cognitive_verbs": COGNITIVE_VERBS, "emotion_words": EMOTION_WORDS, "wh_words": WH_WORDS, "yes_no_openers": YES_NO_OPENERS, "backchannels": BACKCHANNELS,
}


def stopwords() -> list[str]:
    """Function words but negations, fillers, common and referring words."""
    lists = [words for name, words in LSM_CATEGORIES.items() if name != "negations"]
    return sorted({w for words in [*lists, FILLERS, COMMON_WORDS, REFERENCE_WORDS] for w in words})


def lexicon(spark: SparkSession) -> DataFrame:
    """The dimension table (category, term, n_tokens)."""
    rows = [(c, t, len(t.split())) for c, terms in VOCABULARIES.items() for t in dict.fromkeys(terms)]
    return spark.createDataFrame(rows, "category string, term string, n_tokens int")
