"""Word lists of the annotator and the swap.

Names and surnames are parameters everywhere; the tables here are defaults of common English-language ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MALE_NAMES = frozenset("James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Frank Raymond Patrick Jack Dennis Jerry Henry Peter Adam Nathan Zachary Walter Carlos Juan Luis Diego Miguel Omar Ahmed Ali Raj Arjun Ravi Hiroshi Kenji Ivan Oliver Ethan Liam Noah Lucas Mason Logan Elijah".split())
FEMALE_NAMES = frozenset("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Ruth Brenda Pamela Nicole Katherine Samantha Christine Emma Catherine Virginia Rachel Carolyn Janet Maria Heather Diane Julie Joyce Victoria Kelly Christina Joan Evelyn Lauren Judith Olivia Sofia Sophia Isabella Mia Ava Charlotte Amelia Aisha Fatima Priya Mei Yuki Elena Alice Grace Rose Lily Hope Joy Claire Elisabeth".split())
UNISEX_NAMES = frozenset("Alex Jordan Taylor Casey Riley Jamie Morgan Avery Quinn Robin Sam Cameron Kerry Leslie Dana".split())
#: The hundred most frequent surnames of the public census of the United States of 2010, in its order, and some frequent ones of Asia.
COMMON_SURNAMES = frozenset("Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Gomez Phillips Evans Turner Diaz Parker Cruz Edwards Collins Reyes Stewart Morris Morales Murphy Cook Rogers Gutierrez Ortiz Morgan Cooper Peterson Bailey Reed Kelly Howard Ramos Kim Cox Ward Richardson Watson Brooks Chavez Wood James Bennett Gray Mendoza Ruiz Hughes Price Alvarez Castillo Sanders Patel Myers Long Ross Foster Jimenez Chen Wang Zhang Liu Singh Kumar Khan".split())
#: Of these, the ones that aren't first names of the dictionary.
SURNAMES = COMMON_SURNAMES - MALE_NAMES - FEMALE_NAMES - UNISEX_NAMES

# Results depend on these.
#: Names that are everyday words too: they need more than a capital letter.
EVERYDAY = frozenset(
    "will may hope grace joy faith rose dawn summer page bill mark art sue pat jack guy earl june april august ray dean sky sunny autumn winter holly ivy iris lily violet hazel ruby amber crystal pearl ginger honey angel chase hunter miles norm rich gay constance prudence patience liberty destiny harmony melody story lee ash reed day love star brook river stone cliff don frank grant gene cole wade drew rob sterling happy lucky merry bliss precious charity honor justice royal sage blessing promise trinity".split()
)
TITLES = frozenset(("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Madam", "Mx"))
TITLE_GENDER = {"Mr": "male", "Mrs": "female", "Ms": "female", "Miss": "female"}
TITLE_TO = {"female": {"Mr": "Ms"}, "male": {"Mrs": "Mr", "Ms": "Mr", "Miss": "Mr"}}
PERSON_NOUNS = frozenset("man men woman women boy boys girl girls gentleman gentlemen lady ladies guy guys gal gals husband wife father mother dad mom mum son sons daughter daughters brother brothers sister sisters uncle aunt nephew niece king queen sir ma'am madam grandfather grandmother grandpa grandma boyfriend girlfriend".split())
TWO_OBJECT_VERBS = frozenset("allow give offer bring lend send show tell grant buy cost owe hand teach promise wish deny spare afford award feed earn".split())
ROLE_PAIRS = (("chairman", "chairwoman"), ("businessman", "businesswoman"), ("repairman", "repairwoman"), ("salesman", "saleswoman"), ("spokesman", "spokeswoman"), ("craftsman", "craftswoman"), ("handyman", "handywoman"), ("fireman", "firewoman"), ("policeman", "policewoman"), ("workman", "workwoman"), ("waiter", "waitress"), ("actor", "actress"), ("steward", "stewardess"), ("host", "hostess"), ("headmaster", "headmistress"))

#: Closed word classes of the rule-based tagger.
DETERMINERS = frozenset("a an the this that these those some any each every no another both all".split())
PREPOSITIONS = frozenset("of in on at to for with from by about into onto over under after before during through between against among without within along across behind beyond near since until upon toward towards up down off out around as like than despite".split())
CONJUNCTIONS = frozenset("and or but nor so yet if because although though while when where whether unless once".split())
AUXILIARIES = frozenset("is are was were be been being am has have had do does did will would shall should can could may might must".split())
PRONOUNS = frozenset("he him himself she hers herself it its itself they them their theirs themselves we us our ours you your yours i me my mine myself who whom whose which what someone everyone nobody".split())
ADVERBS = frozenset("not then there here now today soon later always never often again too very just even still also back home away together once meanwhile finally suddenly however therefore tomorrow yesterday tonight alone ready".split())
ADJECTIVES = frozenset("last first long short new old good great big small little own final next whole hard heavy late early busy quiet tired proud happy sad warm cold dark bright clean difficult important able unable many few several".split())
VERBS = frozenset("go went gone come came get got make made take took see saw know knew think thought leave left keep kept let put set run ran sit sat stand stood tell told give gave find found feel felt begin began write wrote hold held say said bring brought lose lost meet met pay paid read cut shut".split())
IRREGULAR = {"gave": "give", "given": "give", "brought": "bring", "lent": "lend", "sent": "send", "showed": "show", "shown": "show", "told": "tell", "bought": "buy", "taught": "teach", "fed": "feed", "cost": "cost"}


def names_table(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """name, name_gender."""
    return spark.createDataFrame(sorted((names or default_names()).items()), "name string, name_gender string")


def default_names() -> dict[str, str]:
    return dictionary(MALE_NAMES, FEMALE_NAMES | UNISEX_NAMES) | dict.fromkeys(UNISEX_NAMES, "unisex")


def dictionary(male: frozenset[str] | set[str], female: frozenset[str] | set[str]) -> dict[str, str]:
    """Names of one list only, and unisex ones of both."""
    return dict.fromkeys(male - female, "male") | dict.fromkeys(female - male, "female") | dict.fromkeys(male & female, "unisex")


def dictionary_table(male: DataFrame, female: DataFrame) -> DataFrame:
    """The same over tables of names, with set operations."""
    one = lambda df, g: df.select("name", F.lit(g).alias("name_gender"))
    m, f = male.select("name").distinct(), female.select("name").distinct()
    return one(m.join(f, "name", "left_anti"), "male").unionByName(one(f.join(m, "name", "left_anti"), "female")).unionByName(one(m.intersect(f), "unisex"))


def without_first_names(surnames: DataFrame, names: DataFrame) -> DataFrame:
    """name: the surnames that no first name of the dictionary equals."""
    return surnames.select("name").distinct().join(names.select("name"), "name", "left_anti")


def surnames_table(spark: SparkSession, surnames: frozenset[str] = SURNAMES) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(surnames)], "name string")
