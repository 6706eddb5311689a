"""Declared schemas: the union of the places where a field may stand. Nothing is inferred."""

PERSON = "struct<id: string, name: string, displayName: string>"
META = f"struct<title: string, name: string, subtitle: string, author: string, authorName: string, authors: array<{PERSON}>, narrator: string, narratorName: string, narrators: array<string>, series: string, seriesName: string, sequence: string, seriesSequence: string, isbn: string, isbn_13: string, isbn_10: string, isbn10: string, isbn13: string, asin: string, amazonASIN: string, amazon_asin: string, book: string, bookNumber: string, volume: string, publishedYear: string, publishedDate: string, duration: double, length: double, totalLength: double, pages: int, finished: boolean>"
LIBRARY_ITEM = (
    "id string, libraryId string, mediaType string, libraryType string, title string, name string, subtitle string, author string, authors array<" + PERSON + ">, narrator string, isbn string, isbn_13 string, isbn_10 string, isbn10 string, isbn13 string, asin string, amazonASIN string, amazon_asin string, "
    "series string, seriesName string, sequence string, seriesSequence string, book string, bookNumber string, volume string, "
    "publishedYear string, duration double, length double, totalLength double, pages int, current_time double, isFinished boolean, "
    f"metadata {META}, media struct<duration: double, length: double, totalLength: double, pages: int, current_time: double, ebookFile: struct<path: string>, audioFiles: array<struct<path: string>>, metadata: {META}>"
)
MEDIA_PROGRESS = "id string, libraryItemId string, episodeId string, duration double, progress double, ebookProgress double, currentTime double, isFinished boolean, lastUpdate long, startedAt long, finishedAt long"
CONTRIBUTION = "struct<author: struct<id: long, name: string>, person: struct<name: string>, contribution: string, role: string>"
EDITION = f"struct<id: long, isbn_10: string, isbn_13: string, asin: string, pages: int, audio_seconds: int, physical_format: string, reading_format: struct<format: string>, score: double, users_count: long, contributions: array<{CONTRIBUTION}>>"
USER_BOOK = f"id long, user_id long, status_id int, book struct<id: long, title: string, contributions: array<{CONTRIBUTION}>, editions: array<{EDITION}>>"
HIT = "struct<id: string, title: string, author_names: array<string>, activity: double, publication_year: int, series: string>"
SEARCH = f"struct<hits: array<struct<document: {HIT}>>>"

#: A search result in full: fields whose type differs from source to source are read as text.
_WORK_HIT = f"format: string, activity: string, popularity: string, rating_count: string, series: string, seriesName: string, series_name: string, sequence: string, seriesSequence: string, series_sequence: string, book_number: string, volume: string, position: string, publishedYear: string, published_year: string, year: string, publicationYear: string, publication_year: string, releaseDate: string, release_date: string, date: string, contributions: array<{CONTRIBUTION}>"
FULL_HIT = f"struct<id: string, title: string, author: string, author_names: array<string>, reading_format: string, physical_format: string, audio_seconds: string, duration: string, length: string, runtime: string, duration_seconds: string, published: string, created_at: string, updated_at: string, {_WORK_HIT}, book: struct<{_WORK_HIT}>>"
SESSION = "id string, libraryItemId string, userId string, currentTime double, duration double, startedAt long, updatedAt long"
