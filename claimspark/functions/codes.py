"""Code sets and the labels they stand for."""

from __future__ import annotations

# Month names as they appear in claim dates, January first.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Monthly enrollment codes.
PART_A_AND_B = ("3", "C")
NOT_MANAGED_CARE = "0"
NO_PART_D_CONTRACT = ("0", "N", "X")
DUAL_ELIGIBLE = ("01", "02", "03", "04", "05", "06", "08")

# Sex codes.
SEX_LABELS = {"1": "Male", "2": "Female"}
UNKNOWN_SEX = "Unknown"

# Topline category of a claim file that has one category only.
SOURCE_CATEGORY = {"pde": "Retail Pharmacy", "carrier": "Professional", "dme": "Other"}

# Topline category by the first two characters of the bill type.
BILL_TYPE_CATEGORY = {
    "Inpatient Hospital": "11 41",
    "Outpatient Hospital": "13 14 43 44 85 83 78 84 87 71 77 53 54 63 64 72 74 75 79 89 12",
    "Professional": "32 33 34",
    "Long-Term Care": "86 21 23 25 26 27 51 52 18 28 48 58 81 82 16 17 45 47 55 57 65 67",
}

# Subcategory of a claim file that has one subcategory only.
SOURCE_SUBCATEGORY = {"pde": "Prescription drugs (Part D)", "dme": "Durable medical equipment"}

# Subcategory of professional lines by place of service.
PLACE_SUBCATEGORY = {
    "Inpatient/outpatient hospital setting": "19 21 22 23",
    "Office (incl. telehealth)": "11 02 10",
    "Urgent care": "20",
    "Retail clinic": "17",
    "FQHC/RHC": "50 72",
    "Services at home": "12 14 65",
    "Nursing facility / hospice setting": "13 31 32 33 34",
}

# Subcategory of facility claims by bill type.
BILL_TYPE_SUBCATEGORY = {
    "Acute care hospital": "11 41",
    "Hospital outpatient": "13 14 43 44 85 12",
    "Freestanding facility": "83 78 84 87",
    "FQHC/RHC": "71 77",
    "Home health": "32 33 34",
    "Skilled nursing facility": "21 23 25 26 27 51 52",
    "Swing beds": "18 28 48 58",
    "Hospice": "81 82",
    "Residential facility": "86",
    "Intermediate care facility": "16 17 45 47 55 57 65 67",
}

# Type of service by the first letter of the BETOS code.
BETOS_LABELS = {"M": "E&M", "P": "Procedures", "I": "Imaging", "T": "Tests", "D": "DME", "O": "Other"}

# Wellness visits.
WELLNESS_CODES = (
    "G0402 G0438 G0439 G0468 99381 99382 99383 99384 99385 99386 99387 99391 99392 99393 99394 99395 99396 99397"
).split()

# The facility side of a hospital clinic visit, the dialysis code, and clinic bill types.
CLINIC_VISIT_CODE = "G0463"
DIALYSIS_CODE = "90935"
HOSPITAL_OUTPATIENT_BILL = "13"
FQHC_BILL = "77"
CLINIC_FACILITY_TYPE = "7"
HOSPITAL_PLACES = ("19", "22")
OFFICE_VISIT_RANGE = ("99201", "99215")
OFFICE_EM_RANGE = ("99202", "99215")

# Primary care service codes by service group (professional or facility claims).
SERVICE_CODES = {
    "Advance care planning": "99497 99498",
    "Care management": "99424 99425 99426 99427 99437 99491 99439 99483 99487 99489 99490 99495 99496 G0505 G0506",
    "FQHC / clinic visit": "G0466 G0467 T1015",
    "Health risk assessment": "96160 96161",
    "Home visit": "99339 99340 99341 99342 99343 99344 99345 99347 99348 99349 99350",
    "Immunization administration": "90460 90461 90471 90472 90473 90474 G0008 G0009 G0010",
    "Interprofessional consult": "99446 99447 99448 99449 99451 99452",
    "Office visit": "99201 99202 99203 99204 99205 99211 99212 99213 99214 99215",
    "Preventive / wellness visit": (
        "99381 99382 99383 99384 99385 99386 99387 99391 99392 99393 99394 99395 99396 99397 "
        "G0402 G0438 G0439 G0468 S9117"
    ),
    "Prolonged service": "99358 99359 99360 99417 G0513 G0514 G2212",
    "Screening / counseling": (
        "99078 99173 99401 99402 99403 99404 99406 99407 99408 99409 99411 99412 99420 99429 "
        "G0102 G0396 G0397 G0436 G0437 G0442 G0443 G0444"
    ),
    "Team conference / care plan oversight": (
        "99366 99367 99368 99374 99375 99376 99377 99378 99379 99380 G0179 G0180 G0181 G0182"
    ),
    "Telephone / digital E&M": "98966 98967 98968 98970 98971 98972 99421 99422 99423 99441 99442 99443",
}

# The one service code that counts on facility claims only.
FACILITY_ONLY_SERVICE_CODES = {"Hospital outpatient clinic visit (facility)": "G0463"}

# Claim types of the service codes.
PROFESSIONAL_OR_FACILITY = "professional_or_facility"
FACILITY_ONLY = "facility_only"

# Primary care places of service.
PLACES_OF_SERVICE = {
    "02": "Telehealth - outside home",
    "03": "School",
    "10": "Telehealth - in home",
    "11": "Office",
    "12": "Home",
    "13": "Assisted living facility",
    "14": "Group home",
    "19": "Off-campus outpatient hospital",
    "22": "On-campus outpatient hospital",
    "32": "Nursing facility",
    "33": "Custodial care facility",
    "34": "Hospice",
    "50": "Federally qualified health center",
}

# Primary care specialties and whether they are physicians.
SPECIALTIES = {
    "01": ("General practice", "1"),
    "08": ("Family practice", "1"),
    "11": ("Internal medicine", "1"),
    "37": ("Pediatric medicine", "1"),
    "50": ("Nurse practitioner", "0"),
    "97": ("Physician assistant", "0"),
}
