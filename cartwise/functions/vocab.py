"""Word lists, patterns and limits that decide results.

They are data, not logic, and are kept together so that a change of a word is
a change of one line here.
"""

from __future__ import annotations

# Version of the substitution rules; a cached decision of
# another version is void.
RULES_VERSION = 11

# Largest quantity difference in percent per category,
# (automatic, suggested). A category without an entry is never matched.
QUANTITY_LIMITS = {
    "dairy_milk": (20, 50),
    "dairy_yogurt_kefir": (20, 50),
    "dairy_cream_sourcream": (20, 50),
    "drinks_soft_soda": (20, 50),
    "drinks_energy": (20, 50),
    "spices_herbs_spice_mix": (10, 25),
    "dairy_eggs": (0, 40),
    "meat_minced": (15, 30),
    "meat_beef_lamb_game": (15, 30),
    "cheese_regular": (15, 30),
    "cheese_delicatessen": (15, 30),
    "fish_fresh": (15, 30),
    "fish_processed": (15, 30),
    "wine_white": (10, 20),
    "wine_red": (10, 20),
    "wine_rose": (10, 20),
    "baby_porridge_cereal": (0, 0),
    "baby_diapers": (0, 0),
    "baby_care": (0, 0),
    "baby_other": (0, 0),
    "coffee_beans_ground": (15, 30),
    "coffee_instant": (15, 30),
    "tea": (15, 30),
    "dairy_cheese_slices": (15, 30),
    "wine_sparkling": (10, 20),
    "wine_sweet": (10, 20),
    "oils_olive": (15, 30),
    "bakery_bread_loaves": (15, 35),
    "dry_canned_veg": (15, 30),
    "produce_apples_pears": (20, 40),
    "produce_berries": (20, 40),
    "produce_herbs_salads_sprouts": (20, 40),
    "produce_root_veg": (20, 40),
    "produce_tropical": (20, 40),
    "bakery_cakes_pastries": (10, 25),
    "sweets_biscuits_cookies": (10, 25),
    "sweets_candies": (10, 25),
    "sweets_chocolate_bars": (10, 25),
    "sweets_nuts_driedfruit": (15, 30),
    "sweets_snacks_salty": (10, 25),
    "dry_soups_noodles": (15, 30),
    "produce_smoothies_fresh_juices": (15, 30),
    "drinks_juices": (15, 30),
    "drinks_non_alcoholic": (15, 30),
    "drinks_beer_cider": (15, 30),
    "spirits_other": (10, 25),
    "pet_cat_wet": (10, 25),
    "meat_pork": (15, 30),
    "meat_poultry": (15, 30),
    "meat_sausages": (15, 30),
    "meat_grill_blood_sausages": (15, 30),
    "fish_salted_smoked": (15, 30),
}

# Units and their size in the base unit.
UNITS = {
    "ml": ("ml", 1), "l": ("ml", 1000), "cl": ("ml", 10),
    "g": ("g", 1), "kg": ("g", 1000),
    "tk": ("tk", 1), "pcs": ("tk", 1), "pc": ("tk", 1), "piece": ("tk", 1), "pieces": ("tk", 1),
}
MAX_QUANTITY = 100000

# Days a decision stays valid.
DECISION_DAYS = {
    "auto_substitute": 7,
    "suggested_substitute": 2,
    "no_quantity_data": 1,
    "no_eligible_candidates": 1,
    "semantic_rejected": 1,
}

# Traits a substitute must keep (contained words).
REQUIRED_TRAITS = {
    "lactose_free": ("laktoosivaba", "lactose free", "lactose-free", "lakt.vaba", "lakt. vaba", "lakt vaba"),
    "gluten_free": ("gluteenivaba", "gluten free", "gluten-free"),
    "alcohol_free": ("alkoholivaba", "alcohol free", "alcohol-free"),
    "sugar_free": ("suhkruvaba", "sugar free", "sugar-free"),
}
# Traits that must agree both ways.
IDENTITY_TRAITS = {"plant_based": ("taimne", "vegan")}

# Words of flavoured dairy.
FLAVOUR_WORDS = (
    "cappuccino", "latte", "šokolaadi", "shokolaadi", "vanilje", "karamelli", "maasika", "banaani", "kookos",
)

# Contained words per value; the first value that matches counts.
CHEESE_TYPE = {
    "gouda": ("gouda",), "cheddar": ("cheddar",), "mozzarella": ("mozzarella",), "feta": ("feta",),
    "halloumi": ("halloumi",), "parmesan": ("parmesan",), "brie": ("brie",), "maasdam": ("maasdam",),
    "suluguni": ("suluguni",), "kohupiima": ("kohupiim",), "edam": ("edam",), "eesti_juust": ("eesti juust",),
}
CHEESE_FORM = {
    "grated": ("riivitud", "riiv"),
    "sliced": ("viil", "sliced", "viilutatud"),
    "spread": ("määrde", "maarde", "spread"),
    "salad_brined": ("salatijuust", "soolvesi", "soolvees", "kuubik"),
}
YOGURT_FORM = {
    "drinkable": ("joogijogurt", "joogi jogurt", "drinking yogurt"),
    "greek": ("kreeka", "greek"),
    "protein": ("proteiini", "protein"),
}
FISH_SPECIES = {
    "salmon": ("lõhe", "lohe", "salmon"), "cod": ("tursk", "cod"), "herring": ("heering",),
    "baltic_herring": ("räim", "raim"), "trout": ("forell", "trout"), "pike": ("haug", "pike"),
    "tuna": ("tuunikala", "tuna"), "shrimp": ("krevet", "shrimp"),
}
CUT_TYPE = {
    "ground": ("hakkliha", "burgeripihv", "klops"),
    "cubes": ("kuubikud", "lõiked", "loiked", "tükid", "tukid"),
    "antrekoot": ("antrekoodi", "antrekoot"),
    "picanha": ("picanha",),
    "fillet": ("valisfilee", "filee"),
    "romsteak": ("romsteek", "romsteegi"),
    "grillsteik": ("grillsteik",),
    "minute_steak": ("minutisteik",),
    "karbonaad": ("karbonaad",),
}
NUT_SEED_TYPE = {
    "walnut": ("kreeka pähk", "kreeka-pähk", "walnut"),
    "hazelnut": ("sarapuu", "metsapähk", "metspähk", "hazelnut"),
    "almond": ("mandli", "mandel", "almond"),
    "cashew": ("kašu", "cashew"),
    "pistachio": ("pistaatsia", "pistachio"),
    "peanut": ("maapähk", "peanut"),
    "chia": ("chia",),
    "sunflower_seed": ("päevalille", "sunflower"),
    "pumpkin_seed": ("kõrvitsaseemne", "kõrvitsaseeme", "pumpkin seed"),
}
BEVERAGE_TYPE = {
    "beer_style": ("õlu", "beer", "cero", "pils", "lager"),
    "cider_style": ("siider", "cider"),
    "mocktail": ("mocktail", "virgin", "kokteil"),
    "fassbrause": ("fassbrause",),
}
MEAT_FORM = {
    "blood_sausage": ("verivorst",),
    "blood_dumpling": ("verikäkk", "verikook"),
    "shashlik": ("šašlõkk", "sašlõkk", "saslõkk", "shashlik"),
    "grill_sausage": ("grillvorst", "grill vorst"),
    "raw_sausage": ("toorvorst",),
    "fried_sausage": ("praevorst",),
    "kebab": ("kebab",),
    "ribs": ("ribi", "ribid", "ribiliha", "spare rib"),
    "steak": ("steik", "steek"),
    "marinated_cut": ("marineeritud", "marinaadis"),
}
CAFFEINE = {"decaf": ("kofeiinivaba", "decaf", "koffeinfri")}

# Patterns per value; the first value that matches counts.
ANIMAL_TYPE = {
    "mixed": (r"\bsea[\s-]?veise\w*", r"\bveise[\s-]?sea\w*"),
    "beef": (r"\bveise\w*", r"\bhärjaliha\w*", r"\bbeef\b"),
    "pork": (r"\bsea(?:liha|hakk|filee|kaela|karbonaad|sisefilee|välisfilee|vorst|kõrvad?)\w*", r"\bpork\b"),
    "chicken": (r"\bkana\w*", r"\bbroileri\w*", r"\bchicken\b"),
    "turkey": (r"\bkalkuni?\w*", r"\bturkey\b"),
    "duck": (r"\bpardi\w*", r"\bduck\b"),
    "generic_poultry": (r"\blinnuliha\w*", r"\bpoultry\b"),
    "lamb": (r"\blamba\w*", r"\blambaliha\w*", r"\blamb\b"),
    "deer": (r"\bhirve\w*", r"\bdeer\b", r"\bvenison\b"),
}

# Patterns per tag; every tag that matches counts.
FLAVOUR_PROFILE = {
    "classic": (r"\bklassikali\w*",),
    "sweet_chili": (r"\btšilli\w*", r"\btsilli\w*", r"\bchili\w*"),
    "teriyaki": (r"\bteriyaki\b",),
    "bbq": (r"\bbbq\b",),
    "garlic": (r"\bküüslaugu\w*", r"\bkuusklaugu\w*"),
    "lemon_herb": (r"\bsidruni\w*", r"\bürdi\w*", r"\burdi\w*"),
    "smoky": (r"\bsuitsu\w*",),
    "spicy": (r"\bterav\w*", r"\bvürtsika\w*", r"\bvurtsika\w*"),
    "mild": (r"\bmahe\b",),
    "basil": (r"\bbasiiliku\w*", r"\bbasil\w*"),
    "salted": (r"\bsoola\w*",),
    "cheese": (r"\bjuustu\w*",),
    "paprika": (r"\bpaprika\w*",),
    "sour_cream_onion": (r"\bhapukoore\w*",),
    "fruity": (r"\bfruity\b", r"\bpuuviljane\w*", r"\bpuuvilja\w*"),
    "harmony": (r"\bharmony\b",),
    "chicken_flavour": (r"\bkana\w*", r"\bchicken\b"),
    "pork_flavour": (r"\bsealiha\w*", r"\bpork\b"),
    "beef_flavour": (r"\bveise\w*", r"\bbeef\b"),
    "shrimp_flavour": (r"\bkrevet\w*", r"\bshrimp\b"),
    "miso_flavour": (r"\bmiso\w*",),
    "curry_flavour": (r"\bkarri\w*", r"\bcurry\b"),
}
FLAVOUR_VARIANT = {
    "wild_strawberry": (r"\bmetsmaasika\w*",),
    "strawberry": (r"(?<!mets)\bmaasika\w*",),
    "banana": (r"\bbanaani\w*",),
    "blueberry": (r"\bmustika\w*",),
    "peach": (r"\bvirsiku\w*",),
    "apricot": (r"\baprikoosi\w*",),
    "mango": (r"\bmango\w*",),
    "cherry": (r"\bkirsi\w*",),
    "orange": (r"\bapelsini\w*",),
    "lemon": (r"\bsidruni\w*",),
    "raspberry": (r"\bvaarika\w*",),
    "pear": (r"\bpirni\w*",),
    "coconut": (r"\bkookos\w*",),
    "vanilla": (r"\bvanilje\w*",),
    "chocolate": (r"\bšokolaadi\w*", r"\bshokolaadi\w*"),
    "caramel": (r"\bkaramelli\w*",),
    "passion_fruit": (r"\bpassiooni\w*",),
    "kiwi": (r"\bkiivi\w*",),
    "rhubarb": (r"\brabarberi\w*",),
    "pohla": (r"\bpohla\w*",),
    "plum": (r"\bploomi\w*",),
    "cinnamon": (r"\bkaneeli\w*",),
    "rye_bread": (r"\brukkileiva\w*", r"\bleiva\w*"),
    "blackcurrant": (r"\bmustsõstra\w*", r"\bmustsostra\w*"),
    "redcurrant": (r"\bpunas[eõ]stra\w*", r"\bpunase\s+sõstra\w*", r"\bredcurrant\w*"),
    "forest_berries": (r"\bmetsamarja\w*",),
    "apple": (r"\bõuna\w*", r"\bouna\w*"),
    "pineapple": (r"\banan[ae]ssi\w*", r"\bananasi\w*", r"\bpineapple\w*"),
    "grape": (r"\bviinamarja\w*",),
    "watermelon": (r"\barbuusi\w*",),
    "tropical": (r"\btroopili\w*",),
    "pomelo": (r"\bpomelo\w*", r"\bgreibi\w*", r"\bgrapefruit\w*"),
}
DESSERT_ADDON = {
    "cereal": (r"\bteravilja\w*", r"\bm[uü]sli\w*", r"\bmuesli\w*"),
    "cookie": (r"\bküpsise\w*", r"\bkeksi\w*"),
    "ice_cream": (r"\bjäätise\w*", r"\bjaatise\w*"),
    "chocolate_addon": (r"\bšokolaaditükk\w*", r"\bsokolaaditukk\w*"),
}
CHEESE_MODIFIER = {
    "whisky": (r"\bviski\w*", r"\bwhisky\b", r"\bwhiskey\b"),
    "truffle": (r"\btrühvli\w*", r"\btruffel\w*", r"\btruffle\w*"),
    "juniper": (r"\bkadaka\w*", r"\bjuniper\w*"),
    "jalapeno": (r"\bjalape[nñ]o\w*", r"\btšilli\w*", r"\btsilli\w*", r"\bchili\w*"),
    "smoked": (r"\bsuitsu\w*", r"\bsmoked\b"),
    "herbs": (r"\bürdi\w*", r"\burdi\w*", r"\bherb\w*"),
    "garlic": (r"\bküüslaugu\w*", r"\bkuusklaugu\w*", r"\bgarlic\w*"),
    "pepper": (r"\bpipra\w*", r"\bpepper\w*"),
    "walnut": (r"\bpähkli\w*", r"\bpahkli\w*", r"\bwalnut\w*"),
    "caraway": (r"\bköömne\w*", r"\bkoomne\w*", r"\bcaraway\w*"),
    "wine": (r"\bveini\w*", r"\bportveini\w*", r"\bwine\b", r"\bport wine\b"),
    "light": (r"\blight\b", r"\bkerge\w*", r"\bv[aä]hendatud rasva\w*"),
    "aged_long": (r"\b\d+\s*kuud\w*", r"\b\d+\s*p[aä]eva\w*", r"\bvintage\b", r"\bmature\b", r"\baged\b"),
    "forte": (r"\bforte\b",),
}
PROTEIN_ENRICHED = {"protein_enriched": (r"\bproteiini\w*", r"\bprotein\w*")}
GRAIN_TYPE = {
    "rye": (r"\brukki\w*",),
    "wheat": (r"\bnisu\w*",),
    "oat": (r"\bkaera\w*",),
    "barley": (r"\bodra\w*",),
    "spelt": (r"\bspelta\w*",),
    "wholegrain": (r"\bt[äõa]istera\w*",),
    "multigrain": (r"\bmitmevilja\w*", r"\b\d+[\s-]?vilja\w*"),
}
COFFEE_BREW_FORM = {
    "beans": (r"\buba\w*", r"\bbeans?\b"),
    "filter_ground": (r"\bfiltrikohv\w*", r"\bfilter\b"),
    "in_cup": (r"\bin[\s-]?cup\w*", r"\btassikohv\w*"),
    "french_press": (r"\bpresskann\w*", r"\bfrench\s+press\b"),
    "espresso_ground": (r"\bespresso\w*",),
    "instant": (r"\blahustuv\w*", r"\binstant\w*"),
    "capsule": (r"\bkapsli\w*", r"\bcapsule\w*"),
}
COFFEE_PRODUCT_LINE = {
    "qualita_oro": (r"\bqualit[aà]\s*oro\b",),
    "qualita_rossa": (r"\bqualit[aà]\s*rossa\b",),
    "crema_gusto": (r"\bcrema\s*e?\s*gusto\b",),
    "tierra": (r"\btierra\b",),
    "mountain_grown": (r"\bmountain\s*grown\b",),
}
# Olive oil grades, best first; only the first match counts.
OIL_GRADE = {
    "extra_virgin": (r"\bekstra[\s-]*v[aä]äris\w*", r"\bekstra[\s-]*neitsi\w*", r"\bextra\s+virgin\b"),
    "virgin": (r"\bv[aä]äris\w*", r"\bneitsi\w*"),
    "refined": (r"\brafineeritud\w*", r"\brefined\b"),
    "pomace": (r"\bj[aä][aä]kõli\w*", r"\bpomace\b"),
    "light": (r"\bkerge\w*", r"\blight\b"),
}

# Checks per category whose difference removes a candidate.
HARD_CHECKS = {
    "dairy_milk": ("flavour_state", "fat_class_milk"),
    "dairy_yogurt_kefir": ("flavour_state", "fat_class_yogurt", "yogurt_form"),
    "dairy_cream_sourcream": (),
    "meat_minced": ("animal_type",),
    "meat_beef_lamb_game": ("animal_type", "cut_type"),
    "meat_pork": ("animal_type", "cut_type"),
    "meat_poultry": ("animal_type", "cut_type"),
    "coffee_beans_ground": ("caffeine_state",),
    "coffee_instant": ("caffeine_state",),
    "tea": ("caffeine_state",),
    "cheese_regular": ("cheese_type", "cheese_form"),
    "dairy_cheese_slices": ("cheese_type", "cheese_form"),
    "cheese_delicatessen": ("cheese_type", "cheese_form"),
    "fish_fresh": ("fish_species",),
    "fish_salted_smoked": ("fish_species",),
    "fish_processed": ("fish_species",),
    "sweets_nuts_driedfruit": ("nut_seed_type",),
    "drinks_non_alcoholic": ("beverage_type",),
    "meat_sausages": ("animal_type",),
    "meat_grill_blood_sausages": ("animal_type", "meat_form"),
}
# Checks per category whose difference lowers automatic to
# suggested.
DOWNGRADE_CHECKS = {
    "spices_herbs_spice_mix": ("flavour_profile",),
    "dairy_yogurt_kefir": ("flavour_variant", "dessert_addon"),
    "drinks_energy": ("flavour_variant",),
    "drinks_soft_soda": ("flavour_variant",),
    "cheese_regular": ("cheese_modifier",),
    "dairy_cheese_slices": ("cheese_modifier",),
    "cheese_delicatessen": ("cheese_modifier",),
    "sweets_biscuits_cookies": ("flavour_variant",),
    "sweets_candies": ("flavour_variant",),
    "sweets_chocolate_bars": ("flavour_variant",),
    "sweets_nuts_driedfruit": ("flavour_variant",),
    "sweets_snacks_salty": ("flavour_variant", "flavour_profile"),
    "dry_soups_noodles": ("flavour_variant", "flavour_profile"),
    "produce_smoothies_fresh_juices": ("flavour_variant",),
    "drinks_juices": ("flavour_variant",),
    "bakery_cakes_pastries": ("flavour_variant",),
    "tea": ("flavour_variant",),
    "oils_olive": ("flavour_profile", "oil_grade"),
    "meat_minced": ("protein_enriched",),
    "bakery_bread_loaves": ("grain_type",),
    "coffee_beans_ground": ("coffee_brew_form", "coffee_product_line"),
    "coffee_instant": ("coffee_brew_form", "coffee_product_line"),
}
# Categories that are never substituted automatically.
AUTO_DISABLED = (
    "wine_red", "wine_white", "wine_rose", "wine_sparkling", "wine_sweet", "drinks_beer_cider", "drinks_spirits",
    "spirits_vodka", "spirits_whisky", "spirits_gin", "spirits_rum", "spirits_cognac", "spirits_liqueur", "spirits_other",
    "tea", "sweets_candies", "drinks_non_alcoholic", "coffee_beans_ground", "coffee_instant",
)
# Categories where only an automatic match will do.
EXACT_ONLY = (
    "baby_porridge_cereal", "baby_diapers", "baby_care", "baby_other", "baby_wipes",
    "baby_formula", "baby_food_jars", "baby_food_pouches", "baby_snacks",
)
# Produce families, contained word stems and priority.
PRODUCE_FAMILIES = (
    ("chili", ("tšilli", "tsilli", "chili"), 100),
    ("cauliflower", ("lillkaps",), 100),
    ("zucchini", ("suvikõrvits", "suvikorvits"), 100),
    ("tomato", ("tomat",), 50),
    ("potato", ("kartul",), 50),
    ("onion", ("sibul",), 50),
    ("garlic", ("küüslauk", "kuuslauk"), 50),
    ("leek", ("porru",), 50),
    ("cucumber", ("kurk", "kurgi"), 50),
    ("pepper", ("paprika",), 50),
    ("carrot", ("porgand",), 50),
    ("broccoli", ("brokoli",), 50),
    ("cabbage", ("kapsa",), 50),
    ("beet", ("peet", "peedi"), 50),
    ("radish", ("redis",), 50),
    ("turnip", ("naeris", "naeri"), 50),
    ("swede", ("kaalikas", "kaalika"), 50),
    ("celery", ("seller",), 50),
    ("eggplant", ("baklažaan", "baklazaan"), 50),
    ("pumpkin", ("kõrvits", "korvits"), 50),
    ("corn", ("mais",), 50),
    ("asparagus", ("spargel",), 50),
)
FAMILY_FILTER_CATEGORIES = ("produce_root_veg",)

# Categories without a brand filter, and its thresholds.
BRAND_FILTER_BLOCKED = (
    "hh_other", "fish_fresh", "produce_apples_pears", "produce_root_veg", "produce_tropical",
    "produce_mushrooms", "produce_berries", "produce_fruit_salads",
)
MIN_BRANDS, MIN_GROUPS_PER_BRAND, MIN_BRAND_COVERAGE = 2, 3, 0.60

# Ingredients no store is asked for.
SKIP_INGREDIENTS = (
    "water", "salt", "black pepper", "pepper", "white pepper", "mixed herbs", "seasoning", "oil spray", "to taste",
)
# Categories an ingredient without its own list is never bought in.
NON_FOOD_CATEGORIES = (
    "hh_other", "hh_cleaners", "hh_laundry", "hh_dishwashing", "pcare_oral_care", "pcare_other",
    "pcare_feminine_hygiene", "baby_diapers", "pet_cat_wet", "pet_dog_wet", "pet_cat_dry", "pet_dog_dry",
)
# Words that rule a product out as an ingredient.
BASKET_EXCLUDED_WORDS = ("kaitstud", "strooganov", "valmistoit")
RECIPE_EXCLUDED_WORDS = ("kaitstud", "geograafilise", "strooganov", "valmistoit", "praad", "kotlet")

# Chain prefixes of product names.
CHAIN_PREFIXES = (
    r"^https\s+barbora\s+ee\s+toode\s+", r"^coop\s+", r"^rimi\s+", r"^selver\s+", r"^prisma\s+", r"^maxima\s+", r"^lidl\s+",
)
# Size and class endings of product names.
NAME_ENDINGS = (
    r"\s+\d+\s*kl\.?,?\s*kg$", r"\s+i+\s+klass?\b", r"\s+\d+\s*kg$", r",\s*kg$", r"\s+kg$", r"\s+kl\s+kg$", r"\s+pakitud.*$",
)

# Spelling repairs, applied in this order.
ENCODING_REPAIRS = (
    ("oun", "õun"), ("Oun", "Õun"), ("rost", "röst"), ("Rost", "Röst"), ("maaare", "määre"),
    ("taistera", "täistera"), ("Taistera", "Täistera"), ("lohna", "lõhna"), ("Lohna", "Lõhna"),
    ("lohnaline", "lõhnaline"), ("louna", "lõuna"), ("Louna", "Lõuna"), ("saslokk", "šašlõkk"), ("Saslokk", "Šašlõkk"),
    ("saslik", "šašlõkk"), ("Saslik", "Šašlõkk"), ("aadika", "äädika"), ("Aadika", "Äädika"),
    (" olu ", " õlu "), (" olu\n", " õlu\n"), ("Olu ", "Õlu "),
)
ENCODING_SKIP_WORDS = ("bonjour", "rostov", "rostbeef", "rostock")

# Brand cleaning.
UNSET_BRANDS = (
    "maaramata", "maaramata kaubamark", "maaramata tootja",
)
UNSET_LABEL = "Määramata"
BAD_BRAND_WORDS = (
    "tarneviis", "vali aeg", "ostukorv", "add to cart", "lisa ostukorvi", "book delivery", "delivery time", "accept",
    "cookie", "kampaania", "campaign", "logi", "login", "registreeru", "close", "sulge", "continue",
)
OWN_BRAND_PATHS = ("puu-ja-koogiviljad", "food-market")
OWN_BRAND_SECOND_WORDS = ("mahe", "öko", "eko", "organic", "bio")

# Words that mark a scraped row as no product.
NOISE_EXACT = (
    "web tracking bundle", "functional", "required", "marketing", "analytics", "privacy", "cookie", "consent", "pant", "deposit",
)
NOISE_CONTAINED = ("cookie", "consent", "tracking", "privacy")
NOISE_PREFIXES = ("otsi", "avasta", "tulemused")
NOISE_PLACES = ("aabenraa", "aabybro", "aachen", "aalborg", "õnekoski")

# Tokens that carry no meaning in a title.
STOP_TOKENS = ("kg", "tk", "g", "ml", "l", "dl", "cl", "ja", "või", "with", "ilma", "bio", "mahe")

# City words; everything else is the default city.
CITY_WORDS = {"parnu": ("parnu", "pärnu", "prnu"), "tartu": ("tartu",)}
DEFAULT_CITY = "tallinn"

# Street words of an address and the shape of a store name.
ADDRESS_WORDS = ("mnt", "tee", "tn", "pst", "puiestee", "maantee", "tänav", "keskus", "turg", "väljak")
STORE_NAME = r"(Delice(?:\s+Toidupood)?|[A-ZÄÖÜÕ][A-Za-zÄÖÜÕäöüõ0-9'’\- ]{1,60}\sSelver(?:\sABC)?)"

# Specification labels.
BRAND_LABELS = ("bränd", "brand", "tootja", "kaubamärk", "manufacturer", "tootja / päritoluriik", "käitleja", "handler")
BRAND_KEYS = ("kaubamark", "brand", "brand name", "brandname")
MAKER_KEYS = ("tootja", "manufacturer", "valmistaja", "producer")
SIZE_KEYS = ("kogus", "netokogus", "maht", "pakend", "neto", "suurus", "mahtuvus")
GTIN_KEYS = ("gtin13", "gtin8", "gtin14", "gtin")
BARCODE_LABELS = ("ribakood", "barcode", "ean")

# Recipe ingredients in the store language. Exact names first;
# otherwise the first entry contained in the name.
INGREDIENTS = {
    "chicken": "kana", "chicken breast": "kanafileed", "chicken breasts": "kanafileed", "chicken thighs": "kanareis",
    "chicken wings": "kanatiivad", "whole chicken": "terve kana", "beef": "veiseliha", "ground beef": "veisehakkliha",
    "minced beef": "veisehakkliha", "pork": "sealiha", "bacon": "peekon", "pancetta": "peekon", "salmon": "lõhe",
    "pasta": "pasta", "spaghetti": "spaghetti", "fettuccine": "fettuccine", "lasagne sheets": "lasanjeplaadid",
    "rice": "riis", "sushi rice": "sushi riis", "potato": "kartul", "potatoes": "kartulid", "onion": "sibul",
    "onions": "sibulad", "garlic": "küüslauk", "garlic cloves": "küüslauguküüned", "tomato": "tomat",
    "tomatoes": "tomatid", "cherry tomatoes": "kirsstomatid", "tomato puree": "tomatipasta",
    "chopped tomatoes": "konservtomatid", "tinned tomatoes": "konservtomatid", "olive oil": "oliiviõli",
    "oil": "taimeõli", "rapeseed oil": "rapsiõli", "butter": "või", "milk": "piim", "cream": "koor",
    "double cream": "vahukoor", "heavy cream": "vahukoor", "creme fraiche": "hapukoor", "egg": "muna", "eggs": "munad",
    "egg yolks": "munakollased", "cheese": "juust", "parmesan": "parmesan", "parmesan cheese": "parmesan",
    "pecorino": "parmesan", "mozzarella": "mozzarella", "mozzarella balls": "mozzarella", "cheddar": "cheddar",
    "salt": "sool", "pepper": "pipar", "black pepper": "must pipar", "sugar": "suhkur", "caster sugar": "tuhksuhkur",
    "vanilla": "vanill", "flour": "jahu", "plain flour": "nisujahu", "puff pastry": "lehttainas",
    "chicken stock": "kanapuljong", "beef stock": "veisepuljong", "vegetable stock": "köögiviljapuljong",
    "carrot": "porgand", "carrots": "porgandid", "celery": "seller", "fennel": "apteegitill", "mushrooms": "seened",
    "mushroom": "seened", "red pepper": "punane paprika", "capsicum": "paprika", "green beans": "rohelised oad",
    "cabbage leaves": "kapsas", "cabbage": "kapsas", "lemon": "sidrun", "cucumber": "kurk", "soy sauce": "sojakaste",
    "honey": "mesi", "mustard": "sinep", "mayonnaise": "majonees", "breadcrumbs": "riivsai",
    "basil leaves": "basiilik", "basil": "basiilik", "parsley": "petersell", "thyme": "tüümian",
    "cumin seeds": "köömned", "bay leaf": "loorberileht", "clams": "merekarbid", "mussels": "merekarbid",
    "white wine": "valge vein", "red wine": "punane vein", "white chocolate chips": "valge šokolaad",
    "ginger": "ingver", "black olives": "oliivid", "clear honey": "mesi", "balsamic vinegar": "äädikas",
    "rosemary": "rosmariin", "basmati rice": "riis", "rice wine": "riisivein", "cooked chestnut": "keedetud kastanid",
    "cranberry": "jõhvikad", "vanilla extract": "vanilliekstrakt", "vanilla pod": "vanillikaun",
}
# Measures, replaced as whole words in this order.
MEASURES = {
    "as required": "maitse järgi", "as needed": "maitse järgi", "to taste": "maitse järgi", "to serve": "serveerimiseks",
    "tbs": "spl", "tbsp": "spl", "tablespoon": "spl", "tablespoons": "spl", "tblsp": "spl", "tbls": "spl", "tsp": "tl",
    "teaspoon": "tl", "teaspoons": "tl", "cup": "tass", "cups": "tassi", "oz": "g", "lb": "450g", "g": "g", "kg": "kg",
    "ml": "ml", "l": "l", "medium": "tk", "large": "tk", "small": "tk", "clove": "küüs", "cloves": "küünt",
    "cloves minced": "küünt hakitud", "cloves chopped": "küünt hakitud", "slice": "viil", "slices": "viilu",
    "bunch": "kamp", "handful": "peotäis", "pinch": "näputäis", "pod of": "kaun", "pod": "kaun", "top": "peale",
    "topping": "peale", "sprigs of fresh": "oksa värsket", "sprigs": "oksa", "sprig": "oks", "stick": "vars",
    "zest and juice of 1": "koor ja mahl 1-st", "juice of 1": "mahl 1-st", "juice of": "mahl", "chopped": "hakitud",
    "diced": "kuubikuteks", "sliced": "viilutatud", "grated": "riivitud", "minced": "hakitud", "crushed": "purustatud",
    "finely chopped": "peenelt hakitud", "roughly chopped": "jämedalt hakitud", "finely sliced": "peenelt viilutatud",
    "halved": "pooleks", "quartered": "neljaks", "free-range": "vabalt peetud",
}

# Keys whose object is known by its name.
NAMED_OBJECTS = ("brand", "manufacturer")

# Keys that mark an object with a name as an item.
ITEM_MARKS = (
    "price", "baseprice", "base_price", "unit_price", "total_price", "current_price", "priceCurrency",
    "id", "itemId", "itemID", "_id", "slug",
)
