"""The resources of a listing feed: keys, typed columns, dependencies. Everything else is generated from this."""

from __future__ import annotations

import re
from dataclasses import dataclass


def snake_case(name: str) -> str:
    """Payload name -> column name: a word starts at a capital after a small letter or digit, and ends a run of capitals."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


@dataclass(frozen=True)
class Col:
    payload: str
    kind: str  # string, timestamp, date, bool, int16, int32, int64, decimal(p,s), strings
    required: bool = False
    name: str = ""

    @property
    def column(self) -> str:
        return self.name or snake_case(self.payload)

    @property
    def sql_type(self) -> str:
        plain = {"string": "string", "timestamp": "timestamp", "date": "timestamp", "bool": "boolean", "int16": "smallint", "int32": "int", "int64": "bigint", "strings": "array<string>"}
        return plain.get(self.kind, self.kind)


@dataclass(frozen=True)
class Resource:
    name: str
    key: str  # payload name of the natural key
    columns: tuple[Col, ...]
    own_timestamp: bool = True  # ModificationTimestamp in the payload; else that of the raw row
    versioned: bool = True
    extended: bool = True  # keep unknown payload keys
    parent: bool = False  # has parent_listing_key
    api_name: str = ""

    @property
    def key_column(self) -> str:
        return snake_case(self.key)

    @property
    def data_columns(self) -> list[str]:
        return [c.column for c in self.columns]


def _cols(kind: str, names: str) -> list[Col]:
    return [Col(n, kind) for n in names.split()]


# The payload names of the feed's typed columns, by type.
_MONEY, _ACRES, _DEGREES = "decimal(13,2)", "decimal(15,4)", "decimal(11,8)"
_PROPERTY = [
    *_cols("string", "ListingId ParcelNumber MlsStatus StandardStatus MajorChangeType"),
    *_cols("timestamp", "MajorChangeTimestamp"),
    *_cols("date", "ListingContractDate"),
    *_cols("timestamp", "OnMarketTimestamp OriginalEntryTimestamp PhotosChangeTimestamp"),
    *_cols("date", "AvailabilityDate"),
    *_cols(_MONEY, "ListPrice OriginalListPrice PreviousListPrice TaxAnnualAmount"),
    *_cols("int64", "TaxAssessedValue"),
    *_cols("int16", "TaxYear"),
    *_cols("string", "PropertyType PropertySubType"),
    *_cols("bool", "NewConstructionYN"),
    *_cols("int16", "BedroomsTotal BathroomsTotalInteger BathroomsFull BathroomsHalf MainLevelBedrooms"),
    *_cols(_MONEY, "LivingArea BuildingAreaTotal"),
    *_cols(_ACRES, "LotSizeAcres"),
    *_cols(_MONEY, "LotSizeSquareFeet"),
    *_cols("int16", "StoriesTotal YearBuilt"),
    *_cols(_MONEY, "GarageSpaces CoveredSpaces ParkingTotal"),
    *_cols("int16", "FireplacesTotal"),
    *_cols("bool", "PoolPrivateYN WaterfrontYN ViewYN HorseYN"),
    *_cols("string", "StreetNumber"),
    *_cols("int32", "StreetNumberNumeric"),
    *_cols("string", "StreetName StreetSuffix StreetDirPrefix StreetDirSuffix UnitNumber UnparsedAddress City StateOrProvince PostalCode PostalCodePlus4 Country CountyOrParish SubdivisionName MLSAreaMajor"),
    *_cols(_DEGREES, "Latitude Longitude"),
    *_cols("string", "ElementarySchool MiddleOrJuniorSchool HighSchool HighSchoolDistrict"),
    *_cols("string", " ".join(f"{role}{who}{part}" for who in ("Agent", "Office") for role in ("List", "CoList", "Buyer", "CoBuyer") for part in ("Key", "MlsId"))),
    *_cols("bool", "InternetEntireListingDisplayYN InternetAddressDisplayYN InternetAutomatedValuationDisplayYN InternetConsumerCommentYN"),
    *_cols("strings", "Appliances Cooling Heating Flooring Roof ExteriorFeatures InteriorFeatures ParkingFeatures PoolFeatures View WaterfrontFeatures CommunityFeatures AccessibilityFeatures Utilities Sewer WaterSource LotFeatures PatioAndPorchFeatures SecurityFeatures ConstructionMaterials FoundationDetails Levels FireplaceFeatures SpaFeatures Fencing HorseAmenities WindowFeatures PetsAllowed Disclosures PropertyCondition SpecialListingConditions GreenEnergyEfficient GreenSustainability SyndicateTo"),
    *_cols("string", "PublicRemarks SyndicationRemarks Directions Furnished DirectionFaces"),
]
_MEMBER = _cols("string", "MemberMlsId MemberFirstName MemberMiddleName MemberLastName MemberFullName MemberNamePrefix MemberNameSuffix MemberNickname MemberStatus MemberDirectPhone MemberMobilePhone MemberHomePhone MemberPreferredPhone MemberPreferredPhoneExt MemberOfficePhoneExt MemberFax MemberAddress1 MemberAddress2 MemberCity MemberStateOrProvince MemberPostalCode MemberPostalCodePlus4 MemberCountry MemberCountyOrParish OfficeKey OfficeMlsId")
_OFFICE = [
    *_cols("string", "OfficeMlsId OfficeName OfficeStatus OfficeType OfficePhone OfficePhoneExt OfficeFax OfficeAddress1 OfficeAddress2 OfficeCity OfficeStateOrProvince OfficePostalCode OfficePostalCodePlus4 OfficeCountyOrParish OfficeCorporateLicense OfficeNationalAssociationId MainOfficeKey MainOfficeMlsId OfficeBrokerKey OfficeBrokerMlsId OfficeManagerKey"),
    *_cols("bool", "IdxOfficeParticipationYN"),
    *_cols("timestamp", "PhotosChangeTimestamp"),
]
_OPEN_HOUSE = [
    Col("ListingKey", "string", required=True),
    Col("ListingId", "string"),
    Col("OpenHouseDate", "date"),
    *_cols("timestamp", "OpenHouseStartTime OpenHouseEndTime"),
    *_cols("string", "OpenHouseStatus OpenHouseType"),
]
_MEDIA = [
    Col("ResourceName", "string", required=True, name="resource_type"),
    Col("ResourceRecordKey", "string", required=True),
    *_cols("string", "MediaType MediaURL"),
    *_cols("int64", "ImageHeight ImageWidth"),
    *_cols("string", "ImageSizeDescription LongDescription"),
    Col("Order", "int16"),
    Col("PreferredPhotoYN", "bool"),
    Col("MediaModificationTimestamp", "timestamp"),
]
_ROOM = [Col("ListingKey", "string", required=True), *_cols("string", "RoomType RoomLevel"), Col("RoomFeatures", "strings")]
_UNIT = [Col("ListingKey", "string", required=True), Col("UnitTypeBedsTotal", "int16"), Col("UnitTypeFurnished", "string")]
_LOOKUP = [Col("LookupName", "string", required=True), Col("LookupValue", "string", required=True), Col("StandardLookupValue", "string")]
#: Media belong to one of these, named in lower case.
MEDIA_OWNERS = ("property", "member", "office")
#: Embedded arrays of a property record: payload name -> (resource, name of the injected link, its value or None for the parent's key).
CHILDREN = {"Media": ("media", "ResourceName", "Property"), "Rooms": ("property_rooms", "ListingKey", None), "UnitTypes": ("property_unit_types", "ListingKey", None)}

RESOURCES: dict[str, Resource] = {
    r.name: r
    for r in (
        Resource("lookup", "LookupKey", tuple(_LOOKUP), versioned=False, extended=False, api_name="Lookup"),
        Resource("office", "OfficeKey", tuple(_OFFICE), api_name="Office"),
        Resource("member", "MemberKey", tuple(_MEMBER), api_name="Member"),
        Resource("property", "ListingKey", tuple(_PROPERTY), api_name="Property"),
        Resource("open_house", "OpenHouseKey", tuple(_OPEN_HOUSE), parent=True, api_name="OpenHouse"),
        Resource("media", "MediaKey", tuple(_MEDIA), own_timestamp=False, api_name="Media"),
        Resource("property_rooms", "RoomKey", tuple(_ROOM), own_timestamp=False, parent=True, api_name="PropertyRooms"),
        Resource("property_unit_types", "UnitTypeKey", tuple(_UNIT), own_timestamp=False, parent=True, api_name="PropertyUnitTypes"),
    )
}
#: Dependency order of the passes; a property pass brings those of its embedded children along.
PASS_ORDER = tuple(RESOURCES)
FETCHED = ("lookup", "office", "member", "property", "open_house")


def key_field(resource: str) -> str:
    return RESOURCES[resource].key


def from_api_name(name: str) -> str:
    """Feed name -> table name."""
    found = {r.api_name: r.name for r in RESOURCES.values()}
    if name not in found:
        raise ValueError(f"unknown resource {name!r}")
    return found[name]


def passes(requested: list[str] | None = None) -> list[str]:
    """The passes to run for what was fetched, in dependency order."""
    wanted = set(requested or FETCHED)
    if unknown := wanted - set(RESOURCES):
        raise ValueError(f"unknown resources {sorted(unknown)}")
    if "property" in wanted:
        wanted |= {c for c, _, _ in CHILDREN.values()}
    return [r for r in PASS_ORDER if r in wanted]
