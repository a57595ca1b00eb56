"""Fixed values shared by every operator.

Everything below the FIXED VALUES marker must stay exactly as written: the
notes texts, catalog entries and prompt texts are matched character by
character against data and against the SQL oracles.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the behaviour being reproduced; do not edit)
# ---------------------------------------------------------------------------

# Severity classes, exact case, in display order.
CLASSES = ["Urgent", "Upcoming", "Good"]

# Class shown when a component or class is NULL or empty in a distribution.
UNKNOWN = "?"

# Reasoning used when the notes say nothing about a component.
NO_SIGNAL_REASONING = "No relevant signal in notes."

# Seed component catalog:
# (component_key, display_name, description, rubric, sort_order)
SEED_COMPONENTS = [
    ("tires", "Tires",
     "Tread depth, wear pattern, sidewall condition, age.",
     "Urgent: tread under 3/32\", sidewall cracks/bulges, exposed cords, severe dry rot. "
     "Upcoming: tread 3/32\"-4/32\", early sidewall cracking, age 5-6 years, mild cupping/feathering. "
     "Good: tread above 4/32\", even wear, no damage, under ~5 years.", 1),
    ("brakes", "Brake Pads",
     "Friction material thickness, noise, rotor condition.",
     "Urgent: pads under 2mm, grinding/metal-to-metal, brake warning light, rotor scoring. "
     "Upcoming: 3mm-4mm remaining, early squeal, light rotor scoring, glazing. "
     "Good: 5mm+ friction material, even wear, no noise, smooth rotors.", 2),
    ("battery", "Battery",
     "Voltage, cranking health, terminal corrosion, age.",
     "Urgent: failed load test, will not hold charge, severe corrosion. "
     "Upcoming: weak cranking, age 3-5 years, minor corrosion. Good: healthy voltage, clean terminals.", 3),
    ("suspension", "Suspension & Steering",
     "Shocks/struts, bushings, alignment, play in steering.",
     "Urgent: leaking struts, broken springs, unsafe play. "
     "Upcoming: worn bushings, alignment drift, early shock wear. Good: no play, rides level.", 4),
    ("engine_oil", "Engine Oil",
     "Oil color/viscosity, level, change interval.",
     "Urgent: very low/contaminated oil, metal particles. "
     "Upcoming: due for change soon, slightly dark. Good: clean oil, within interval.", 5),
    ("coolant", "Coolant",
     "Level, color/contamination, leaks.",
     "Urgent: low/contaminated coolant, visible leak, overheating. "
     "Upcoming: slightly low, due for flush. Good: correct level and condition.", 6),
    ("transmission_fluid", "Transmission Fluid",
     "Level, color, burnt smell.",
     "Urgent: burnt/very dark fluid, low level, shifting issues. "
     "Upcoming: darkening, due for service. Good: clean, correct level.", 7),
    ("belts_hoses", "Belts & Hoses",
     "Cracks, fraying, leaks on serpentine/timing belts and hoses.",
     "Urgent: cracked/frayed belt, leaking/swollen hose. "
     "Upcoming: minor cracking, age-based replacement nearing. Good: supple, no cracks.", 8),
    ("lights_electrical", "Lights & Electrical",
     "Headlights, indicators, wipers, electronics function.",
     "Urgent: non-functioning safety lights. Upcoming: dimming/intermittent, bulb nearing end. "
     "Good: all functioning.", 9),
    ("wipers", "Wiper Blades",
     "Streaking, tearing, chatter.",
     "Urgent: blades torn, large unswept areas. Upcoming: streaking/chatter starting. Good: clean wipe.", 10),
    ("exhaust", "Exhaust System",
     "Leaks, corrosion, noise, emissions.",
     "Urgent: exhaust leak, loud noise, failed emissions. Upcoming: surface corrosion, minor noise. "
     "Good: intact, quiet.", 11),
    ("ac", "Air Conditioning",
     "Cooling performance, refrigerant, cabin filter.",
     "Urgent: no cooling, compressor failure. Upcoming: weak cooling, dirty cabin filter. Good: cools well.", 12),
]

# Observation phrases of the phrase-type components, as (Good, Upcoming, Urgent).
PHRASES = {
    "suspension": (
        "Suspension: struts dry, no measurable play.",
        "Suspension: light strut weep, ~1mm ball-joint play.",
        "Suspension: front strut leaking, ~3mm ball-joint play.",
    ),
    "engine_oil": (
        "Engine oil: amber, level full.",
        "Engine oil: darkened, level mid, ~1k mi to interval.",
        "Engine oil: black/thick, level 1qt low.",
    ),
    "coolant": (
        "Coolant: level full, clean.",
        "Coolant: ~10% low, slight discoloration.",
        "Coolant: below MIN, contaminated.",
    ),
    "transmission_fluid": (
        "ATF: bright red, level full.",
        "ATF: light brown, level ok.",
        "ATF: dark brown, burnt odor.",
    ),
    "belts_hoses": (
        "Serpentine belt: no cracking; hoses firm.",
        "Serpentine belt: minor surface cracks; upper hose slightly soft.",
        "Serpentine belt: frayed edge/glazing; lower hose seeping.",
    ),
    "lights_electrical": (
        "Lights: all exterior functional.",
        "Lights: RH low-beam dim, license plate lamp out.",
        "Lights: RH brake lamp inoperative.",
    ),
    "wipers": (
        "Wipers: clean wipe, no chatter.",
        "Wipers: light streaking on driver side.",
        "Wipers: torn driver blade, large unswept band.",
    ),
    "exhaust": (
        "Exhaust: intact, no leaks, light surface rust.",
        "Exhaust: moderate corrosion at mid-pipe.",
        "Exhaust: leak at flange, perforation starting.",
    ),
}

SERVICE_TYPES = ["Scheduled maintenance", "Multi-point inspection", "Oil change",
                 "Brake inspection", "Diagnostic check", "Tire rotation"]
MODEL_TYPES = ["Sedan", "SUV", "Coupe", "Hatchback", "Convertible", "Truck"]
SPECIALIZATIONS = ["Engine", "Brakes", "Electrical", "Tires", "General Maintenance"]
VEHICLE_MAKE = "Best Automobile"
AC_VENT_TEMPS = [40, 44, 48, 55, 62, 70]

# Generator choice lists and ranges (uniform picks).
TREAD_CHOICES = [2, 3, 3, 4, 5, 6, 7, 8, 9]
FRONT_PAD_CHOICES = [1.5, 2, 3, 3, 4, 5, 6, 7]
REAR_PAD_CHOICES = [2, 3, 4, 5, 6, 7, 8]
BATTERY_VOLTS = (11.4, 12.8)      # one decimal
BATTERY_AGE_YEARS = (1, 7)
VEHICLES_PER_CUSTOMER = (1, 3)
SERVICES_PER_VEHICLE = (1, 4)
COMPONENTS_PER_SERVICE = (3, 6)
N_TECHNICIANS = 10
VEHICLE_YEARS = (2018, 2024)
SERVICE_DAYS_BACK = 730

# Curated demo services, ids 1..8: (notes, flagged components, ground truth).
DEMO_SERVICES = [
    ("Tread depth (32nds): LF 2, RF 2, LR 3, RR 3. Brake pad thickness: front 1.5mm, rear 2mm. "
     "Battery: 12.5V resting, age 2 yr.",
     [], {"tires": "Urgent", "brakes": "Urgent", "battery": "Good"}),
    ("Wipers: torn driver blade, large unswept band. Tread depth (32nds): LF 2, RF 3, LR 2, RR 4. "
     "Brake pad thickness: front 1.5mm, rear 3mm.",
     ["wipers"], {"wipers": "Urgent", "tires": "Urgent", "brakes": "Urgent"}),
    ("Tread depth (32nds): LF 1, RF 2, LR 2, RR 3. Brake pad thickness: front 1.5mm, rear 2mm. "
     "Engine oil: amber, level full.",
     [], {"tires": "Urgent", "brakes": "Urgent", "engine_oil": "Good"}),
    ("Tread depth (32nds): LF 8, RF 7, LR 8, RR 7. Brake pad thickness: front 7mm, rear 6mm. "
     "Coolant: level full, clean.",
     [], {"tires": "Good", "brakes": "Good", "coolant": "Good"}),
    ("Tread depth (32nds): LF 2, RF 3, LR 4, RR 4. Brake pad thickness: front 4mm, rear 3mm. "
     "Lights: all exterior functional.",
     ["tires"], {"tires": "Urgent", "brakes": "Upcoming", "lights_electrical": "Good"}),
    ("Tread depth (32nds): LF 4, RF 4, LR 5, RR 5. Brake pad thickness: front 1.5mm, rear 2mm. "
     "Lights: RH low-beam dim, license plate lamp out.",
     [], {"tires": "Upcoming", "brakes": "Urgent", "lights_electrical": "Upcoming"}),
    ("Tread depth (32nds): LF 2, RF 2, LR 2, RR 2. Brake pad thickness: front 1.5mm, rear 1.5mm.",
     [], {"tires": "Urgent", "brakes": "Urgent"}),
    ("Tread depth (32nds): LF 8, RF 8, LR 7, RR 8. Brake pad thickness: front 2mm, rear 1.5mm. "
     "Battery: 12.4V resting, age 3 yr.",
     [], {"tires": "Good", "brakes": "Urgent", "battery": "Good"}),
]
DEMO_DATE = "2024-05-15"
DEMO_SERVICE_TYPE = "Multi-point inspection"

# Default prompt: header lines, component line format, footer lines.
DEFAULT_PROMPT_HEADER = [
    "You are an expert automotive service advisor. Read the technician's service "
    "notes and assess upsell/replacement opportunity for each of the components "
    "listed below.",
    "",
    "For EACH component, classify as exactly one of:",
    "- Urgent: replace immediately for safety or function.",
    "- Upcoming: replacement recommended at the next service interval.",
    "- Good: no action needed, or the notes contain no relevant signal.",
    "",
    "Components to assess:",
]
DEFAULT_PROMPT_FOOTER = [
    "",
    "Return one assessment per component with a concise reasoning grounded in the "
    "notes. If the notes say nothing about a component, classify it 'Good' with "
    "reasoning 'No relevant signal in notes.'",
]

# Contract appended to every prompt: {keys} is the comma-joined key list.
CONTRACT_PREFIX = "\n\nReturn an assessment for EACH of these component keys exactly: ["
CONTRACT_SUFFIX = ("]. Use the component key verbatim in the 'component' field. "
                   "'classification' must be one of ['Urgent', 'Upcoming', 'Good'].")

# Separator between the prompt and the notes sent for scoring.
NOTES_SEPARATOR = "\n\nService notes:\n"

# Follow-up email prompt pieces.
EMAIL_PROMPT_INTRO = (
    "You are an automotive service communication assistant. Write a personalized, empathetic, "
    "professional follow-up email to a customer who recently serviced their vehicle. The technician "
    "found issues that need attention soon for safety. Acknowledge their visit, restate the issue in "
    "plain language, explain the safety relevance without alarm, and offer to schedule the work. "
)
EMAIL_PROMPT_OUTRO = ". Keep it concise, warm, and trust-building."

# Model options of each call kind; scoring adds tokens for each component.
SCORING_OPTIONS = {"temperature": 0.0, "max_tokens": 256}
EMAIL_OPTIONS = {"temperature": 0.3, "max_tokens": 1024}

# Sample size and fan-out defaults (arguments override them).
DEFAULT_SAMPLE_ROWS = 50
MAX_TEST_PARTITIONS = 32
FULL_RUN_PARTITIONS = 32

# Expected sample tables and their order in a status report.
SAMPLE_TABLES = ["customer", "vehicle", "technician", "service"]

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------

COMPONENT_KEYS = [c[0] for c in SEED_COMPONENTS]
