"""Explicit schemas as DDL text; production reads never infer one.

Fixed values throughout: field names and types of the files, feeds and records read.
"""

RAW_REVIEW = (
    "business_name string, author_name string, text string, rating int, "
    "rating_category string"
)
SOURCE_REVIEW = ("title string, stars int, text string, publishedAtDate string")
LABELLED_REVIEW = (
    "company_name string, review_date date, text string, stars int, category string, label int"
)
EXTENDED_REVIEW = (
    "company_name string, reviewer_name string, review_date date, text string, stars int, "
    "category string, image_urls string, image_captions string, `group` string"
)
SYNTHETIC_REVIEW = (
    "company_name string, reviewer_name string, review_date date, text string, stars int, "
    "category string, image_urls string, image_captions string, `group` string, "
    "irrelevant boolean, violation_type string"
)
BUSINESS_PAGE = (
    "name string, website string, phone string, address string, logo string, "
    "claim_status string, open_hours map<string,string>"
)
# One element of a review-feed response body; the body is an array of these.
REVIEW_FEED = (
    """data struct<business: struct<
        reviewCount: bigint,
        reviews: struct<edges: array<struct<node: struct<
            encid: string,
            text: struct<full: string, language: string>,
            rating: bigint,
            feedback: struct<coolCount: bigint, funnyCount: bigint, usefulCount: bigint>,
            author: struct<encid: string, displayName: string, displayLocation: string,
                reviewCount: bigint, friendCount: bigint, businessPhotoCount: bigint>,
            business: struct<encid: string, alias: string, name: string>,
            createdAt: struct<utcDateTime: string>,
            businessPhotos: array<struct<encid: string, photoUrl: struct<url: string>,
                caption: string, helpfulCount: bigint>>,
            businessVideos: variant,
            availableReactionsContainer: struct<availableReactions: array<struct<
                displayText: string, reactionType: string, count: bigint>>>
        >>>>
    >>"""
)

# Record contracts: a field that is NOT NULL here may be absent but not null.
# Unknown fields are allowed.
PAGE_CONTRACT = (
    "name string NOT NULL, website string NOT NULL, phone string NOT NULL, "
    "address string NOT NULL"
)
REVIEW_CONTRACT = (
    """encid string NOT NULL,
    text struct<full: string NOT NULL> NOT NULL,
    rating bigint NOT NULL,
    author struct<encid: string NOT NULL, displayName: string NOT NULL,
        displayLocation: string NOT NULL, reviewCount: bigint NOT NULL,
        friendCount: bigint NOT NULL, businessPhotoCount: bigint NOT NULL> NOT NULL,
    business struct<encid: string NOT NULL, alias: string NOT NULL,
        name: string NOT NULL> NOT NULL,
    createdAt string NOT NULL,
    businessPhotos array<struct<encid: string NOT NULL, photoUrl: string NOT NULL,
        caption: string>> NOT NULL"""
)
LISTING_CONTRACT = (
    """bizId string NOT NULL,
    searchResultBusiness struct<
        name: string NOT NULL, rating: double, reviewCount: bigint, phone: string,
        businessAttributes: struct<licenses: array<struct<
            license_number: string NOT NULL, license_expiration_date: string,
            license_verification_url: string NOT NULL,
            license_verification_status: string NOT NULL,
            license_verification_date: string NOT NULL, license_issuing_authority: string,
            license_type: string NOT NULL, license_source: string NOT NULL>>> NOT NULL,
        alias: string NOT NULL> NOT NULL"""
)
